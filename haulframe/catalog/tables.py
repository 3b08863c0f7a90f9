"""Declarations read out of the order tables.

A line item is a declaration: the customer is the angler, the part's brand the
species, the supplier decides the zone. Each function reads only the tables
and columns its columns need, so a query that asks nothing about anglers does
not join the orders.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.operators.outings import outing_key
from haulframe.plans.cleaning import fishing_mode
from haulframe.plans.rules import (
    BOAT, DEFAULT_MODES, SHORE, UNDETERMINED, AnglerRules, CleaningRules, Correction,
    CountRules, ModeRules,
)
from haulframe.sources import columns as C

DEFAULT_ZONE = "Open sea"

MODES = ModeRules(
    pattern="lo[- ]?w|coulée",
    pattern_mode=DEFAULT_MODES.pattern_mode,
    subzones=DEFAULT_MODES.subzones,
    techniques={"1-URGENT": BOAT, "2-HIGH": SHORE, "3-MEDIUM": UNDETERMINED},
)
COUNTS = CountRules(
    zones=(1, 7, 4, 6, 5, 8), cap=150, limit=100, reset=1,
    exempt=tuple(f"Brand#{k}" for k in range(1, 6)), note="odd catch",
)
ANGLER_LIMITS = AnglerRules(
    boat_limits=((4, 4), (7, 3), (1, 4)), limit=5, reset=1, note="odd anglers"
)
RULES = CleaningRules(
    date_min="1996-07-01",
    default_zone_name=DEFAULT_ZONE,
    invalid_zone_note="zone -1 read as 8",
    corrections=(Correction(7, C.CATCHES, 1, "photo shows 1"),),
    modes=MODES,
    counts=COUNTS,
    anglers=ANGLER_LIMITS,
)

LINE_COLUMNS = {
    # one number per row: order, line, part, supplier and quantity together are a key; from 1,800,000 orders on it exceeds 64 bits
    C.ROW_ID: "CAST(l_orderkey * 8 + l_linenumber AS DECIMAL(20, 0)) * 640000000000BD "
    "+ ((CAST(l_partkey AS DECIMAL(20, 0)) * 10000BD + l_suppkey) * 64BD + CAST(l_quantity AS BIGINT))",
    C.SESSION: "l_shipdate",
    C.ZONE_ID: "CASE WHEN l_suppkey % 10 = 9 THEN NULL WHEN l_suppkey % 10 = 0 THEN -1L ELSE l_suppkey % 10 END",
    C.ZONE: "CASE WHEN l_suppkey % 10 <> 9 THEN concat('Zone ', l_suppkey % 10) END",
    C.SUBZONE_ID: "CAST(l_linenumber + 12 AS BIGINT)",
    C.SUBZONE: "concat('Sub ', l_linenumber + 12)",
    C.CATCHES: "CASE WHEN l_quantity <= 3 THEN 0D WHEN l_quantity <= 12 THEN 1D "
    "WHEN l_linenumber = 7 THEN l_quantity * 5 ELSE l_quantity END",
    C.ANGLERS: "CAST(l_linenumber - 1 AS DOUBLE)",
    C.FEDERATION: "nullif(l_returnflag, 'N')",
    C.DURATION: "l_discount * 100",
    C.NO_KILL: "nullif(l_tax, 0D)",
}
PART_COLUMNS = {
    C.SPECIES: "p_brand",
    C.VERNACULAR: "concat(p_brand, ' ', p_type)",
    C.FAO_CODE: "upper(substr(p_type, 1, 3))",
    C.SIZE: "CASE WHEN l_discount = 0 THEN 0D WHEN l_tax = 0 THEN NULL ELSE CAST(p_size * 10 AS DOUBLE) END",
    # the last factor keeps sums clear of rounding ties
    C.WEIGHT: "CAST(p_size * p_size * p_size AS DOUBLE) / 100 * CASE l_linenumber WHEN 1 THEN 1D "
    "WHEN 2 THEN 1D / 1000 WHEN 3 THEN l_quantity WHEN 4 THEN l_quantity / 1000 "
    "WHEN 5 THEN -10D WHEN 6 THEN 0D END * 1.000371938D",
}
ORDER_COLUMNS = {C.ANGLER: "o_custkey", C.TECHNIQUE: "o_orderpriority"}


# Layouts of the test tables; a given schema saves a job per read.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the declaration columns they can give."""
    return _with_lines(table(spark, sf_dir, "lineitem"))


def _with_lines(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.expr(e) for name, e in LINE_COLUMNS.items()}).withColumns({
        C.KEPT: F.when(F.col("l_linenumber") % 2 == 0, F.col(C.CATCHES)).otherwise(0.0),
        C.RELEASED: F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col(C.CATCHES)),
    })


def row_number(row_id: str = C.ROW_ID) -> Column:
    """A row's number as a bigint: the number itself, or its last 63 bits where it has more.

    Rows are ordered by the number itself.
    """
    return (F.col(row_id) % F.lit(Decimal(1 << 63))).cast("bigint")


def catches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with species, size and weight."""
    part = table(spark, sf_dir, "part")
    joined = lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.withColumns({name: F.expr(e) for name, e in PART_COLUMNS.items()})


def with_angler(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    joined = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumns({name: F.expr(e) for name, e in ORDER_COLUMNS.items()})


def with_outing(df: DataFrame) -> DataFrame:
    """Mode, zone label and outing id; an angler has one session per month."""
    return df.withColumns({
        C.SESSION: F.trunc(C.SESSION, "month").cast("timestamp_ntz"),
        C.ZONE: F.coalesce(C.ZONE, F.lit(DEFAULT_ZONE)),
        C.MODE: fishing_mode(MODES),
    }).withColumns({C.MONTH: F.month(C.SESSION), C.OUTING: outing_key()})


def outing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_outing(with_angler(lines(spark, sf_dir), spark, sf_dir))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_outing(with_angler(catches(spark, sf_dir), spark, sf_dir))


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand with its number ``k``."""
    return (
        table(spark, sf_dir, "part").select(F.col("p_brand").alias(C.SPECIES)).distinct()
        .withColumn("k", F.expr(f"CAST(replace({C.SPECIES}, 'Brand#', '') AS INT)"))
    )


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species(spark, sf_dir).selectExpr(
        C.SPECIES, f"k AS {C.ROW_ID}",
        "CASE WHEN k % 5 <> 0 THEN 0.01D END AS a_FB", "3D AS b_FB",
        "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'med' ELSE 'hors med' END AS origine_FB",
        "CASE WHEN k % 3 = 0 THEN 0.00001D END AS a_SIH", "3D AS b_SIH",
        "CASE WHEN k % 3 <> 0 THEN NULL WHEN k % 4 = 0 THEN 'med' ELSE 'hors med' END AS origine_SIH",
        "CASE WHEN k % 2 = 1 THEN 0.01D END AS a_obs", "3D AS b_obs",
        "CASE WHEN k % 2 = 1 THEN 'med' END AS origine_obs",
        "50D AS Taille_min_ratio", "350D AS Taille_max_ratio", "k % 3 <> 1 AS ratio_robuste",
    )


def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species(spark, sf_dir).selectExpr(
        C.SPECIES, f"CASE WHEN k % 7 <> 0 THEN 400D END AS {C.SIZE_MAX}",
        f"CASE WHEN k % 4 <> 0 THEN 1000D END AS {C.WEIGHT_MAX}",
    )


def legal_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal minimum size per vernacular name, with a file position."""
    names = table(spark, sf_dir, "part").selectExpr(
        f"p_partkey AS {C.ROW_ID}", f"concat(p_brand, ' ', p_type) AS {C.VERNACULAR}",
        "CAST(replace(p_brand, 'Brand#', '') AS INT) AS k",
    )
    return names.selectExpr(
        C.ROW_ID, C.VERNACULAR, f"CASE WHEN k % 6 <> 0 THEN CAST(k * 10 + 60 AS DOUBLE) END AS {C.LEGAL_SIZE}"
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-zones of two sites, named after the line numbers, and one that never
    occurs."""
    numbers = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return numbers.select(
        F.explode(F.expr(
            "CASE WHEN l_linenumber <= 3 THEN array(struct('banyuls' AS site, concat('Sub ', l_linenumber + 12) AS name)) "
            "WHEN l_linenumber <= 5 THEN array(struct('calanques' AS site, concat('Sub ', l_linenumber + 12) AS name)) "
            "WHEN l_linenumber = 6 THEN array(struct('banyuls' AS site, 'Sub 99' AS name), struct('calanques' AS site, 'Sub 98' AS name)) "
            "ELSE array() END"
        )).alias("z")
    ).select("z.site", F.col("z.name").alias(C.SUBZONE))


def raw_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations under the export's own headers, with re-sent copies.

    The first two lines of an order are sent twice, with another time stamp.
    """
    sent = F.explode(F.when(F.col("l_linenumber") <= 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    # line items are joined as they are: the many columns that they give would be shuffled with them
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    d = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    d = _with_lines(d).withColumns({name: F.expr(e) for name, e in {**PART_COLUMNS, **ORDER_COLUMNS}.items()}).withColumn("copy", sent)
    return d.select(
        (F.col(C.ROW_ID) * F.lit(Decimal(2)) + F.col("copy")).alias(C.ROW_ID),
        F.col(C.SESSION).alias("Heure debut session"),
        F.col(C.SIZE).alias("Taille (mm)"),
        F.col(C.WEIGHT).alias("Poids (g)"),
        F.round(C.DURATION).alias("Durée de la session"),
        F.col(C.NO_KILL).alias("Nokill"),
        F.concat(F.lit("#"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_orderkey"))).alias("Id Prise"),
        F.col("copy").cast("string").alias("Horodate"),
        F.lit(None).cast("double").alias("Latitude"),
        F.lit(None).cast("double").alias("Longitude"),
        F.lit(None).cast("string").alias("Lien photo"),
        F.col(C.ZONE_ID), F.col(C.ZONE), F.col(C.SUBZONE_ID), F.col(C.SUBZONE), F.col(C.TECHNIQUE),
        F.col(C.FEDERATION).alias("Nom Fédération"),
        F.col(C.SPECIES).alias(C.VERNACULAR),
        F.col(C.SPECIES),
        F.col(C.FAO_CODE),
        F.col(C.CATCHES).alias("Nb de prises"),
        F.col(C.KEPT).alias("Nb conservées"),
        F.col(C.RELEASED).alias("Nb relâchées"),
        F.col(C.ANGLERS).alias("Nb de pêcheurs"),
        F.col(C.ANGLER).cast("string").alias("Id Abonné"),
    )
