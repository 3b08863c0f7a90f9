"""What is brought together in one task, and how much is shuffled or stored."""

import os
import re
from collections import Counter

from pyspark.sql import functions as F

from haulframe.operators import outings
from haulframe.plans import rule_tables, selections
from haulframe.sources import columns as C
from haulframe.sources.shared import shared_dir


def test_rows_without_an_id_are_dealt_to_all_tasks(spark):
    d = spark.range(4000).select(
        F.col("id").alias(C.ROW_ID), F.when(F.col("id") % 4 == 0, F.col("id")).alias(C.CATCH_ID), F.lit(2.0).alias(C.CATCHES), F.lit(None).cast("string").alias(C.NOTE)
    )
    given = spark.range(4000).selectExpr("id AS position", f"id AS `{C.CATCH_ID}`", f"'{C.CATCHES}' AS column", "9D AS value", "'n' AS note")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for rows in (d, d.drop(C.ROW_ID).withColumn(C.SIZE, F.col(C.CATCH_ID) * 0.0 + 1).withColumn("n", F.monotonically_increasing_id())):
            found = rule_tables.correct(rows, given).withColumn("task", F.spark_partition_id())
            assert found.columns == [*rows.columns, "task"]
            # whole rows, as the optimizer leaves out a join that nothing is taken from
            assert max(Counter(r["task"] for r in found.collect()).values()) < 2000
            assert found.where(F.col(C.CATCH_ID).isNotNull()).agg(F.sum(C.CATCHES), F.count("*")).first() == (9000.0, 1000)
            assert found.where(F.col(C.CATCH_ID).isNull()).agg(F.count(C.CATCHES), F.count("*")).first() == (0, 3000)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_an_id_that_equals_a_digest_of_a_row_without_one(spark):
    """A row without an id is dealt by a number that may be an id, and still matches nothing."""
    d = spark.createDataFrame([(5, None, 2.0, "x")], f"{C.ROW_ID} bigint, `{C.CATCH_ID}` bigint, `{C.CATCHES}` double, `{C.NOTE}` string")
    number = d.select(F.xxhash64(C.ROW_ID)).first()[0]
    given = spark.createDataFrame([(1, number, C.CATCHES, 3.0, "n")], rule_tables.CORRECTIONS)
    assert tuple(rule_tables.correct(d, given).first()) == (5, None, None, None)


def _stored(spark):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(shared_dir(spark)) for f in files if f.endswith(".parquet"))


def test_the_table_of_cells_stores_little_per_outing(spark):
    n = 40_000
    d = spark.range(n).select(
        F.lit(2026).alias(C.YEAR), (F.col("id") % 12).cast("int").alias(C.MONTH_NUMBER), F.lit("z").alias(C.ZONE), F.lit("Bateau").alias(C.MODE),
        F.md5(F.col("id").cast("string")).alias(C.OUTING), (F.col("id") % 50).cast("string").alias(C.ANGLER), F.lit(1.0).alias(C.CATCHES),
    )
    before = _stored(spark)
    cells = selections.selectable(d)
    assert _stored(spark) - before < 60 * n  # three tables with the whole digest held more than 90 bytes
    assert tuple(selections.figures(cells).first()) == (50, n, 0, float(n))


def test_outings_are_shuffled_by_packed_digests(spark):
    texts = [None, "", "b", "a", "a\0", "x" * 15, "x" * 16, "g" * 32, "0" * 32, "f" * 32, "F" * 32, "0" * 31 + "1"]
    d = spark.createDataFrame([*enumerate(texts * 2)], f"n int, `{C.OUTING}` string")
    found = outings.with_outing_labels(d)
    assert found.columns == ["n", C.OUTING, "outing_label"]
    rows = sorted(found.collect())
    assert [r[C.OUTING] for r in rows] == texts * 2
    labels = {r[C.OUTING]: r["outing_label"] for r in rows}
    assert sorted(labels.values()) == [f"S{i:06}" for i in range(1, len(texts) + 1)]
    assert labels["0" * 32] < labels["0" * 31 + "1"] < labels["f" * 32]
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((.*)\)", plan)
    assert dealt and not [x for x in dealt if f"{C.OUTING}#" in x]
