"""Missing-value rules, one small frame each."""

import pytest
from pyspark.sql import functions as F

from haulframe.functions import calendar, semantics as S, text
from haulframe.operators import filters, joins, reshape, top
from haulframe.sources import columns as C


def values(df, column="r"):
    return [row[column] for row in df.orderBy("i").collect()]


def test_conditions_that_cannot_be_decided(spark):
    d = spark.createDataFrame([(0, 5.0), (1, 200.0), (2, None)], "i int, n double")
    assert values(d.select("i", S.if_else3(F.col("n") > 100, F.lit(1.0), F.col("n")).alias("r"))) == [5.0, 1.0, None]
    d = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "i int, s string")
    assert values(d.select("i", S.not_in("s", ["a"]).alias("r"))) == [False, True, True]
    assert values(d.select("i", S.is_in("s", ["a"]).alias("r"))) == [True, False, False]
    assert values(d.select("i", text.mentions("s", "a").alias("r"))) == [True, False, False]


def test_numbers(spark):
    d = spark.createDataFrame(
        [(0, 1.0, None), (1, -8.0, 0.5), (2, 2.0, 3.0), (3, float("nan"), 1.0), (4, None, 2.0)],
        "i int, x double, y double",
    )
    assert values(d.select("i", S.power("x", "y").alias("r"))) == [1.0, None, 8.0, None, None]
    assert values(d.select("i", S.nan_to_null("x").alias("r")))[3:] == [None, None]
    d = spark.createDataFrame([(0, 1.0, 0.0), (1, 6.0, 4.0), (2, 1.0, None)], "i int, x double, y double")
    assert values(d.select("i", S.divide("x", "y").alias("r"))) == [None, 1.5, None]


def test_aggregates_over_gaps(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, None, None), (2, None, None)], "o int, x double, s string")
    row = d.agg(S.sum0("x").alias("s"), S.n_distinct("s").alias("n"), S.n_distinct("o").alias("m")).first()
    assert (row.s, row.n, row.m) == (0.0, 2, 2)
    assert d.where("false").agg(S.n_distinct("s").alias("n")).first().n == 0
    d = spark.createDataFrame([(2, 7.0), (1, None)], "o int, x double")
    assert d.agg(S.first_by("x", "o").alias("f")).first().f is None


def test_row_counts(spark):
    d = spark.createDataFrame([(0, "med", None, "x"), (1, None, None, None), (2, "med", "med", "med")], "i int, a string, b string, c string")
    assert values(d.select("i", S.count_present("a", "b", "c").alias("r"))) == [2, 0, 3]
    assert values(d.select("i", S.count_equal("med", "a", "b", "c").alias("r"))) == [1, 0, 3]


def test_texts(spark):
    d = spark.createDataFrame([(0, "#41 161"), (1, "none"), (2, None), (3, "0012")], "i int, s string")
    assert values(d.select("i", text.digits_id("s").alias("r"))) == [41161, None, None, 12]
    d = spark.createDataFrame([(0, "COULÉE"), (1, "Sous Marin"), (2, "Lancer"), (3, None)], "i int, s string")
    assert values(d.select("i", text.matches("s", "sous[- ]?marin|coulée").alias("r"))) == [True, True, False, None]
    d = spark.createDataFrame([(0, " Cap Béar - nord - 2"), (1, "A-B"), (2, None)], "i int, s string")
    assert values(d.select("i", text.zone_key("s").alias("r"))) == ["Cap Béar", "A-B", None]
    assert values(d.select("i", text.present_label("s").alias("r"))) == ["oui", "oui", "non"]


def test_notes(spark):
    d = spark.createDataFrame(
        [(0, None, True), (1, "", True), (2, "old", True), (3, "old", False), (4, "old", None), (5, None, False)],
        "i int, note string, c boolean",
    )
    got = values(d.select("i", text.add_note("note", "new", F.col("c")).alias("r")))
    assert got == ["new", "new", "old ; new", "old", None, None]


def test_calendar(spark):
    d = spark.sql("SELECT 0 AS i, TIMESTAMP_NTZ'2025-08-03 23:59:59' AS t UNION ALL SELECT 1, NULL")
    assert values(d.select("i", calendar.weekday_label("t").alias("r"))) == ["dimanche", None]
    assert values(d.select("i", calendar.month_label("t").alias("r"))) == ["août", None]


def test_filters(spark):
    d = spark.sql(
        "SELECT * FROM VALUES (0, TIMESTAMP_NTZ'2024-12-31 23:59:59'), (1, TIMESTAMP_NTZ'2025-01-01 00:00:00'), (2, NULL) t(i, ts)"
    )
    assert values(filters.since(d, "2025-01-01", "ts"), "i") == [1]
    assert values(filters.in_year(d, 2024, "ts"), "i") == [0]
    assert filters.in_year(d, None).count() == 3
    with pytest.raises(ValueError):
        filters.in_months(d, [], "ts")
    d = spark.createDataFrame([(0, "Bord"), (1, "Indeterminable"), (2, None)], f"i int, {C.MODE} string")
    assert values(filters.determinable_mode(d), "i") == [0]
    assert values(filters.of_mode(d, "Bord"), "i") == [0]
    d = spark.createDataFrame(
        [(0, 1.0, 12.0, 10.0, 5.0, None), (1, 1.0, 12.1, 10.0, 5.0, None), (2, 1.0, 99.0, None, 6.0, 5.0),
         (3, 1.0, 99.0, None, 6.1, 5.0), (4, 2.0, 1.0, None, 1.0, None), (5, 1.0, None, 10.0, 1.0, None)],
        f"i int, {C.CATCHES} double, {C.SIZE} double, {C.SIZE_MAX} double, {C.WEIGHT} double, {C.WEIGHT_MAX} double",
    )
    assert values(filters.plausible_singles(d), "i") == [0, 2]


def test_missing_keys_match(spark):
    left = spark.createDataFrame([(0, "a"), (1, None), (2, "z")], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 9)], "k string, v int")
    got = joins.with_dimension(left, right, ["k"], ["v"]).collect()
    assert sorted(got, key=str) == sorted([(0, "a", 1), (0, "a", 2), (1, None, 9), (2, "z", None)], key=str)
    assert sorted(r.i for r in joins.present_in(left, right, ["k"]).collect()) == [0, 1]


def test_uncount(spark):
    d = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", None)], "k string, n double")
    assert [tuple(r) for r in reshape.uncount(d, "n").collect()] == [("a",), ("a",)]
    many = spark.createDataFrame([("a", 1023.0), ("b", 1024.0), ("c", 1025.0), ("d", 5000.0), ("e", 0.0)], "k string, n double")
    got = {r.k: r["count"] for r in reshape.uncount(many, "n").groupBy("k").count().collect()}
    assert got == {"a": 1023, "b": 1024, "c": 1025, "d": 5000}
    for bad in (-1.0, 1.5):
        with pytest.raises(Exception, match="not a repeat count"):
            reshape.uncount(spark.createDataFrame([("a", bad)], "k string, n double"), "n").collect()


def test_steps(spark):
    d = spark.createDataFrame([("a", 1.2), ("b", None), ("c", 0.0), ("d", -1.0)], "k string, top double")
    got = [(r.k, r.x) for r in reshape.add_steps(d, "top", 0.5, "x").orderBy("k", "x").collect()]
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("c", 0.0)]


def test_top_order_ties_and_labels(spark):
    d = spark.createDataFrame([("b", 5.0), ("a", 5.0), (None, 5.0), ("c", None), ("d", 9.0)], "k string, n double")
    assert [r.k for r in top.top_n(d, "n", ["k"], 4).collect()] == ["d", "a", "b", None]
    ranked = top.ranked_labels(top.top_n(d, "n", ["k"], 2), "n", ["k"], "k")
    got = {r.k: r.species_rank for r in top.in_label_order(d.where("k = 'a' OR k = 'c'"), ranked, "k").collect()}
    assert got == {"a": 2, None: None}
    with_missing = top.ranked_labels(top.top_n(d, "n", ["k"], 4), "n", ["k"], "k")
    assert sorted((r.k, r.species_rank) for r in with_missing.collect()) == [("a", 2), ("b", 3), ("d", 1)]
    twice = spark.createDataFrame([("s1", "x", 2.0), ("s2", "x", 1.0)], "s string, k string, n double")
    with pytest.raises(Exception, match="label repeats"):
        top.ranked_labels(twice, "n", ["s", "k"], "k").collect()


def test_share_of_nothing(spark):
    d = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, n double")
    assert {r.p for r in top.percent_of_total(d, "n", "p", ["n"]).collect()} == {None}
