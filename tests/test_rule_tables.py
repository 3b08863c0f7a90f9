"""Rules as tables against the literal rules, and what only tables allow."""

import itertools

import pytest
from pyspark.sql import functions as F

from haulframe.plans import cleaning, rule_tables
from haulframe.plans.rules import CleaningRules, Correction
from haulframe.sources import columns as C

RULES = CleaningRules(corrections=(Correction(5, C.CATCHES, 1, "one"), Correction(6, C.CATCHES, 2, "two"), Correction(6, C.ANGLERS, 3, "three")))


@pytest.fixture(scope="module")
def tables(spark):
    return rule_tables.tables_of(spark, RULES)


def rows_of(df, *names):
    return sorted(map(tuple, df.select("n", *names).collect()), key=str)


def grid(spark, schema, *values):
    rows = [(i, *v) for i, v in enumerate(itertools.product(*values))]
    return spark.createDataFrame(rows, "n int, " + schema)


def test_corrections_equal_the_chain(spark, tables):
    d = grid(spark, f"`{C.CATCH_ID}` bigint, `{C.CATCHES}` double, `{C.ANGLERS}` double, `{C.NOTE}` string", [None, 5, 6, 7], [None, 9.0], [4.0], [None, "", "a"])
    names = (C.CATCHES, C.ANGLERS, C.NOTE)
    assert rows_of(rule_tables.correct(d, tables.corrections), *names) == rows_of(cleaning.correct(d, RULES.corrections), *names)


def test_corrections_that_contradict(spark):
    d = spark.createDataFrame([(1, 8.0, 2.0, "x"), (2, 8.0, 2.0, None), (None, 8.0, 2.0, "y")], f"`{C.CATCH_ID}` bigint, `{C.CATCHES}` double, `{C.ANGLERS}` double, `{C.NOTE}` string")
    given = [(3, 1, C.CATCHES, 3.0, "third"), (1, 1, C.CATCHES, 1.0, "first"), (2, 1, C.ANGLERS, None, "second"), (9, None, C.CATCHES, 4.0, "nobody")]
    found = rule_tables.correct(d, spark.createDataFrame(given, rule_tables.CORRECTIONS)).orderBy(F.col(C.CATCH_ID).asc_nulls_last()).collect()
    assert [tuple(r) for r in found] == [(1, 3.0, None, "x ; first ; second ; third"), (2, 8.0, 2.0, None), (None, None, None, None)]
    untouched = rule_tables.correct(d, spark.createDataFrame([], rule_tables.CORRECTIONS))
    assert sorted(map(str, untouched.collect())) == sorted(map(str, d.collect()))
    wrong = rule_tables.correct(d, spark.createDataFrame([(1, 1, "colour", 3.0, "")], rule_tables.CORRECTIONS))
    with pytest.raises(Exception, match="no such column to correct: colour"):
        wrong.collect()


def test_many_corrections_have_one_plan(spark):
    d = spark.createDataFrame([(77_777, 8.0, None)], f"`{C.CATCH_ID}` bigint, `{C.CATCHES}` double, `{C.NOTE}` string")

    def corrected(n):
        given = spark.range(n).select(
            F.col("id").alias("position"), F.col("id").alias(C.CATCH_ID), F.lit(C.CATCHES).alias("column"), (F.col("id") % 5).cast("double").alias("value"), F.lit("n").alias("note"))
        return rule_tables.correct(d, given)

    few, many = (corrected(n)._jdf.queryExecution().optimizedPlan().toString() for n in (10, 100_000))
    assert few.count("\n") == many.count("\n") and abs(len(few) - len(many)) < 200
    assert corrected(100_000).first()[C.CATCHES] == 2.0


def test_modes_equal_the_chain(spark, tables):
    d = grid(
        spark, f"`{C.ZONE_ID}` bigint, `{C.SUBZONE_ID}` bigint, `{C.TECHNIQUE}` string",
        [None, 4, 7, 8], [None, 13, 16, 35, 84, 99], [None, "Lancer", "Traine", "Chasse sous marine", "à la coulée", "x"],
    )
    modes = RULES.modes
    by_table = rule_tables.with_mode(d, tables.subzones, tables.techniques, modes.pattern, modes.pattern_mode)
    assert rows_of(by_table, C.MODE) == rows_of(d.withColumn(C.MODE, cleaning.fishing_mode(modes)), C.MODE)


COUNTS = [None, 0.0, 1.0, 2.0, 8.0, 9.0, 12.0, 13.0, 30.0, 31.0, 100.0, 101.0, 150.0, 151.0, -1.0]


def test_caps_equal_the_chain(spark, tables):
    d = grid(spark, f"`{C.ZONE_ID}` bigint, `{C.VERNACULAR}` string, `{C.CATCHES}` double", [None, 1, 2, 3, 7, 8], [None, "Girelle", "Sar"], COUNTS).withColumn("flag", F.lit(False))
    by_table = rule_tables.cap_catches(d, tables.counts, tables.exempt, "flag")
    assert by_table.columns == d.columns
    assert rows_of(by_table, C.CATCHES, "flag") == rows_of(cleaning.cap_catches(d, RULES.counts, "flag"), C.CATCHES, "flag")


def test_crews_equal_the_chain(spark, tables):
    d = grid(spark, f"`{C.MODE}` string, `{C.ZONE_ID}` bigint, `{C.ANGLERS}` double", [None, "Bateau", "Bord"], [None, 1, 4, 7, 8], COUNTS).withColumn("flag", F.lit(False))
    by_table = cleaning.cap_crowds(rule_tables.cap_crews(d, tables.crews, "flag"), RULES.anglers, "flag")
    assert rows_of(by_table, C.ANGLERS, "flag") == rows_of(cleaning.cap_anglers(d, RULES.anglers, "flag"), C.ANGLERS, "flag")


def test_zones_with_limits_of_their_own(spark):
    counts = spark.createDataFrame([(1, 50.0, 10.0, 2.0), (2, 500.0, 300.0, 5.0)], rule_tables.COUNTS)
    exempt = spark.createDataFrame([("s",)], rule_tables.EXEMPT)
    d = spark.createDataFrame(
        [(0, 1, "x", 11.0), (1, 2, "x", 11.0), (2, 2, "s", 501.0), (3, None, "x", 11.0), (4, None, "x", 10.0), (5, 1, "s", 51.0)],
        f"n int, `{C.ZONE_ID}` bigint, `{C.VERNACULAR}` string, `{C.CATCHES}` double",
    ).withColumn("flag", F.lit(False))
    found = rows_of(rule_tables.cap_catches(d, counts, exempt, "flag"), C.CATCHES, "flag")
    assert found == [(0, 2.0, True), (1, 11.0, False), (2, 500.0, True), (3, None, None), (4, 10.0, False), (5, 50.0, True)]


def test_rules_that_overlap(spark, tables):
    d = spark.createDataFrame([(0, 7, 13, "x")], f"n int, `{C.ZONE_ID}` bigint, `{C.SUBZONE_ID}` bigint, `{C.TECHNIQUE}` string")
    more = spark.createDataFrame([(7, 13, "Bateau"), (None, 1, "Bord"), (7, 13, None)], rule_tables.SUBZONES)
    with pytest.raises(Exception, match="sub-zone rules overlap: 7, 13"):
        rule_tables.with_mode(d, tables.subzones.unionByName(more), tables.techniques, "zz", "z").collect()
    twice = rule_tables.with_mode(d, tables.subzones.unionByName(tables.subzones), tables.techniques, "zz", "z")
    assert rows_of(twice, C.MODE) == [(0, "Bord")]
    bad = spark.createDataFrame([(1, 50.0, 60.0, 2.0)], rule_tables.COUNTS)
    e = d.withColumns({C.VERNACULAR: F.lit("s"), C.CATCHES: F.lit(1.0), "flag": F.lit(False)}).withColumn(C.ZONE_ID, F.lit(1).cast("bigint"))
    with pytest.raises(Exception, match="reset <= limit < cap"):
        rule_tables.cap_catches(e, bad, tables.exempt, "flag").collect()
