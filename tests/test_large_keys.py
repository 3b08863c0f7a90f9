"""Tables whose keys are so large that a row's number has more than 64 bits."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from haulframe.catalog import tables as T
from haulframe.catalog.queries import QUERIES
from haulframe.sources import columns as C

SHIFT = 9_000_000 * 70  # a multiple of all that the tables take remainders by
EXPORTS = ("export_parse", "export_scan", "export_multiline", "export_headers")
OTHERS = ("clean_pipeline", "clean_pipeline_tables", "incremental_load", "cpue_by_mode", "cpue_by_species", "cpue_summary", "cpue_summary_weight", "curve")


def written(spark, path, shift):
    """Small tables with ``shift`` added to the keys of orders and lines."""
    day = lambda i: datetime(1996 + i % 3, 1 + i % 12, 1 + i % 28)
    rows = {
        "orders": [(k + shift, k % 5, "O", 1.0, day(k), ("1-URGENT", "2-HIGH", "5-LOW")[k % 3]) for k in range(11, 26)],
        "part": [(k, f"part {k}", f"Brand#{k % 9 + 1}", f"TYPE {k % 2}", 5 + k % 40, 1.0) for k in range(1, 13)],
        "lineitem": [
            (k + shift, (k * 5 + n) % 12 + 1, (k * 3 + n) % 8 + 1, n, float((k * 7 + n * 11) % 50 + 1), 10.0, k % 5 / 100, n % 3 / 100, "NRA"[k % 3], "O", day(k + n))
            for k in range(11, 26) for n in (1, 2, 4, 7)
        ],
    }
    for name, table in rows.items():
        spark.createDataFrame(table, T.SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("small"), 0)


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("large"), SHIFT)


def number(r):
    return (((r["l_orderkey"] * 8 + r["l_linenumber"]) * 1_000_000 + r["l_partkey"]) * 10_000 + r["l_suppkey"]) * 64 + int(r["l_quantity"])


def test_row_numbers(spark, small, large):
    for path in (small, large):
        rows = T.lines(spark, path).withColumn("n", T.row_number()).collect()
        assert all(r[C.ROW_ID] == Decimal(number(r)) and r["n"] == number(r) % 2**63 for r in rows)
        assert len({r["n"] for r in rows}) == len(rows) == 60


def comparable(df, shift):
    """Rows without their numbers and the notes that name orders; order keys are as they were before the shift."""
    found = df.drop("row_id", "note")
    if "catch_id" in found.columns:
        found = found.withColumn("catch_id", F.col("catch_id") - shift)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("name", EXPORTS + OTHERS)
def test_large_keys_give_the_same_rows(spark, small, large, name):
    few, many = QUERIES[name](spark, small), QUERIES[name](spark, large)
    assert few.schema == many.schema and few.count() > 0
    assert comparable(few, 0) == comparable(many, SHIFT)
