"""Reference tables: length-weight coefficients, size limits, sub-zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.functions.text import zone_key
from haulframe.sources import columns as C

# Table layouts.
COEFFICIENT_SCHEMA = (
    "NomScientifique string, a_obs double, b_obs double, origine_obs string, "
    "Taille_min_ratio double, Taille_max_ratio double, ratio_robuste boolean, "
    "a_FB double, b_FB double, origine_FB string, "
    "a_SIH double, b_SIH double, origine_SIH string"
)
SIZE_LIMIT_SCHEMA = (
    "NomScientifique string, NomVernaculaire string, "
    "Taille_max_mm double, Poids_max_g double, TMC_Med double"
)


# Text conventions of the reference tables.
CSV_OPTIONS = {"nullValue": "NA", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"}


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV or Parquet with a fixed layout, plus the row position."""
    if path.rstrip("/").endswith(".parquet"):
        names = [f.split()[0] for f in schema.split(", ")]
        C.require_columns(spark.read.parquet(path), names)
        table = spark.read.schema(schema).parquet(path)
    else:
        table = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, **CSV_OPTIONS)
    return table.withColumn(C.ROW_ID, F.monotonically_increasing_id())


def parse_table(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a reference table from text lines without a header; other columns are kept."""
    parsed = lines.withColumn("_r", F.from_csv("value", schema, CSV_OPTIONS))
    return parsed.select(*(c for c in lines.columns if c != "value"), "_r.*")


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, COEFFICIENT_SCHEMA)


def read_size_limits(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, SIZE_LIMIT_SCHEMA)


def read_zones(
    spark: SparkSession, path: str, site: str, label: str, strip_suffix: bool
) -> DataFrame:
    """Sub-zones of one site: key plus the untouched remaining columns.

    ``label`` names the column that holds the sub-zone label;
    ``strip_suffix`` drops everything after ``" -"`` in it.
    """
    raw = (
        spark.read.parquet(path)
        if path.rstrip("/").endswith(".parquet")
        else spark.read.csv(path, header=True)
    )
    return zones_of(raw, site, label, strip_suffix)


def zones_of(raw: DataFrame, site: str, label: str, strip_suffix: bool) -> DataFrame:
    key = zone_key(label) if strip_suffix else F.col(label)
    return raw.withColumns({"site": F.lit(site), C.SUBZONE: key})
