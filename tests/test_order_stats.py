"""Quantiles, boxplots and histograms against direct computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulframe.operators import order_stats


def frame(spark, seed, n=800):
    """Group "hot" holds half of the rows; values repeat, some are missing."""
    r = random.Random(seed)
    rows = [
        (r.choice(["hot", "hot", "a", None]),
         r.choice([None, float("nan"), round(r.gauss(50, 20), r.choice([0, 3]))] + [round(r.expovariate(0.05), 1)] * 4),
         r.choice([None, 0.0, 1.0, 2.0, 7.0]))
        for _ in range(n)
    ] + [("one", 3.0, 1.0), ("empty", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, w double").repartition(5), rows


def by_group(rows, weighted):
    groups = {}
    for g, x, w in rows:
        if x is not None and not math.isnan(x):
            groups.setdefault(g, []).extend([x] * (int(w or 0) if weighted else 1))
    return {g: sorted(v) for g, v in groups.items() if v}


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles(spark, weighted):
    d, rows = frame(spark, 1)
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q995": 0.995, "q1": 1.0}
    got = {r.g: r for r in order_stats.quantiles(d, ["g"], "x", probs, "w" if weighted else None).collect()}
    want = by_group(rows, weighted)
    assert got.keys() == want.keys()
    for g, xs in want.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), abs=1e-9)


def test_without_groups(spark):
    d, rows = frame(spark, 2)
    xs = sorted(x for _, x, _ in rows if x is not None and not math.isnan(x))
    assert order_stats.quantiles(d, [], "x", {"m": 0.5}).first().m == pytest.approx(np.median(xs))
    box = order_stats.boxplot(d, [], "x").first()
    assert (box.n, box.middle) == (len(xs), pytest.approx(np.median(xs)))
    assert order_stats.axis_bound(d.where("x IS NULL"), ["g"], "x").first().axis_max is None


def tukey(xs):
    n = len(xs)
    depth = ((n + 3) // 2) / 2

    def at(rank):
        return (xs[math.floor(rank) - 1] + xs[math.ceil(rank) - 1]) / 2

    return at(depth), at((n + 1) / 2), at(n + 1 - depth)


@pytest.mark.parametrize("hinges", ["tukey", "quantile"])
def test_boxplot(spark, hinges):
    d, rows = frame(spark, 3)
    got = {r.g: r for r in order_stats.boxplot(d, ["g"], "x", hinges).collect()}
    want = by_group(rows, False)
    assert got.keys() == want.keys()
    for g, xs in want.items():
        low, mid, high = tukey(xs) if hinges == "tukey" else np.quantile(xs, [0.25, 0.5, 0.75])
        inside = [x for x in xs if low - 1.5 * (high - low) <= x <= high + 1.5 * (high - low)]
        ends = (min(inside), max(inside))
        if hinges == "quantile":
            ends = (min(low, *ends), max(high, *ends))
        r = got[g]
        assert (r.lower_hinge, r.middle, r.upper_hinge) == pytest.approx((low, mid, high))
        assert (r.lower_whisker, r.upper_whisker) == pytest.approx(ends)
        assert (r.n, r.n_outliers) == (len(xs), len(xs) - len(inside))
    bound = order_stats.axis_bound(d, ["g"], "x").first().axis_max
    if hinges == "tukey":
        assert bound == pytest.approx(max(r.upper_whisker for r in got.values()) * 1.05)


def test_a_group_that_holds_nearly_everything(spark):
    """Only values around the sought ranks are ranked, however many a group has."""
    d = spark.range(200_000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("g").alias("g"), (((F.col("id") * 7919) % 200_000) - 50_000).cast("double").alias("x")
    )
    merged = order_stats.merged_values(d, ["g"], "x")
    near = order_stats.ranked_near(merged, ["g"], order_stats.interpolation_ranks(0.5)).collect()
    assert len(near) < 200
    values = {}
    for r in d.collect():
        values.setdefault(r.g, []).append(r.x)
    got = {r.g: r for r in order_stats.quantiles(d, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.995}).collect()}
    for g, xs in values.items():
        assert (got[g].a, got[g].b, got[g].c) == pytest.approx(tuple(np.quantile(xs, [0.25, 0.5, 0.995])))


def test_missing_values_take_no_place(spark):
    d = spark.createDataFrame([("g", None), ("g", None), ("g", float("nan")), ("g", 1.0), ("g", 3.0), ("h", None)], "g string, x double")
    assert [(r.g, r.m) for r in order_stats.quantiles(d, ["g"], "x", {"m": 0.5}).collect()] == [("g", 2.0)]


def test_classes_never_fall(spark):
    xs = [float("-inf"), -1e300, -5.0, -1e-9, -0.0, 0.0, 1e-300, 1e-9, 0.1, 1.0, 1.0000001, 2.0, 1e10, 1e300, float("inf")]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    classes = [r.c for r in d.select("x", order_stats._class(F.col("x")).alias("c")).orderBy("x").collect()]
    assert classes == sorted(classes)


def test_histogram_edges(spark):
    d = spark.createDataFrame(
        [(0.0, 1), (0.5, 1), (10.0, 2), (10.5, 3), (20.0, 4), (30.0, 5), (31.0, 6), (None, 7), (25.0, 0)], "x double, w int"
    )
    got = order_stats.histogram(d, [], "x", "w", high=F.lit(30.0)).orderBy("class_max").collect()
    assert [(r.class_min, r.class_max, r.n_fish) for r in got] == [(0.0, 10.0, 3), (10.0, 20.0, 7), (20.0, 30.0, 5)]
