"""Exact quantiles, boxplot statistics and histograms over weighted values.

``percentile`` gathers every distinct value of a group in one task. Here a first
aggregation counts the weight in narrow classes of values, whose limits depend on
nothing but the value. The classes in order tell in which one a rank lies, and only
values of such classes are ranked one by one. A group that holds nearly all rows
costs one row per class and task, and its other values are never sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.functions.semantics import divide, nan_to_null
from haulframe.operators.joins import match_missing

WHISKER = 1.5
#: Classes per factor e of the value: two values of a class differ by 0.003 % at most.
CLASSES = 32_768


def merged_values(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Groups, ``value`` and ``w``: the weight of each distinct value that is not missing."""
    amount = F.count(F.lit(1)).cast("double") if weight is None else F.sum(F.col(weight).cast("double"))
    return (
        df.groupBy(*groups, nan_to_null(F.col(value).cast("double")).alias("value"))
        .agg(amount.alias("w"))
        .where((F.col("w") > 0) & F.col("value").isNotNull())
    )


def _class(v: Column) -> Column:
    """A whole number that never falls while the value grows."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * CLASSES)).cast("bigint")


def ranked_near(merged: DataFrame, groups: Sequence[str], ranks: Iterable[Column]) -> DataFrame:
    """The values around some ranks with their places.

    ``ranks`` are 0-based whole numbers, as expressions of ``n``. Columns: groups,
    ``value``, ``w``, ``before`` (weight of smaller values), ``n`` (weight of the group).
    """
    groups = list(groups)
    classed = merged.withColumn("_class", _class(F.col("value")))
    in_order = Window.partitionBy(*groups).orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)
    # one row per class: some thousands for a group whose values span a few powers of ten
    classes = classed.groupBy(*groups, "_class").agg(F.sum("w").alias("_in")).withColumns({
        "_base": F.sum("_in").over(in_order) - F.col("_in"), "n": F.sum("_in").over(Window.partitionBy(*groups)),
    })
    holds = reduce(Column.__or__, ((F.col("_base") <= r) & (r < F.col("_base") + F.col("_in")) for r in ranks))
    sought = classes.where(holds).drop("_in")
    running = Window.partitionBy(*groups, "_class").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return match_missing(classed, sought, [*groups, "_class"], "inner").select(
        *groups, "value", "w", "n", (F.col("_base") + F.sum("w").over(running) - F.col("w")).alias("before")
    )


def _at_rank(rank: Column) -> Column:
    """Aggregate: the value on the 0-based rank, of a ``ranked_near`` table for that rank."""
    return F.max(F.when(F.col("before") <= rank, F.col("value")))


def _ends(place: Column) -> list[Column]:
    return [F.floor(place), F.ceil(place)]


def _place(p: float) -> Column:
    return (F.col("n") - 1) * p


def interpolated(p: float) -> Column:
    """Aggregate over ``ranked_near(..., interpolation_ranks(p))``."""
    place = _place(p)
    low, high = (_at_rank(r) for r in _ends(place))
    share = F.max(place) - F.floor(F.max(place))
    return low + (high - low) * share


def interpolation_ranks(*probs: float) -> list[Column]:
    return [r for p in probs for r in _ends(_place(p))]


def _halfway(rank: Column) -> Column:
    return (_at_rank(F.floor(rank)) + _at_rank(F.ceil(rank))) / 2


def quantiles_of(merged: DataFrame, groups: Sequence[str], probs: dict[str, float]) -> DataFrame:
    ranked = ranked_near(merged, groups, interpolation_ranks(*probs.values()))
    return ranked.groupBy(*groups).agg(*(interpolated(p).alias(name) for name, p in probs.items()))


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    return quantiles_of(merged_values(df, groups, value, weight), groups, probs)


def boxplot(
    df: DataFrame, groups: Sequence[str], value: str, hinges: str = "quantile", weight: str | None = None
) -> DataFrame:
    """Box and whiskers per group.

    ``hinges="quantile"`` takes interpolated quartiles and never lets a whisker
    end inside the box; ``hinges="tukey"`` takes the medians of the two halves
    and the plain extremes inside the fences.
    """
    groups = list(groups)
    values = merged_values(df, groups, value, weight)
    if hinges == "quantile":
        ranks = interpolation_ranks(0.25, 0.5, 0.75)
        low, mid, high = (interpolated(p) for p in (0.25, 0.5, 0.75))
    elif hinges == "tukey":
        n = F.col("n")
        depth = F.floor((n + 3) / 2) / 2 - 1  # 0-based
        places = (depth, (n - 1) / 2, n - 1 - depth)
        ranks = [r for p in places for r in _ends(p)]
        low, mid, high = (_halfway(p) for p in places)
    else:
        raise ValueError(f"unknown hinges: {hinges}")
    box = ranked_near(values, groups, ranks).groupBy(*groups).agg(
        low.alias("lower_hinge"), mid.alias("middle"), high.alias("upper_hinge"), F.max("n").alias("n")
    )
    reach = (F.col("upper_hinge") - F.col("lower_hinge")) * WHISKER
    inside = (F.col("value") >= F.col("lower_hinge") - reach) & (
        F.col("value") <= F.col("upper_hinge") + reach
    )
    facts = ["lower_hinge", "middle", "upper_hinge", "n"]
    measured = (
        match_missing(values, box, groups, "inner") if groups
        else values.withColumn("_box", box.select(F.struct(*facts).alias("b")).scalar()).select("value", "w", "_box.*")
    )
    lowest = F.min(F.when(inside, F.col("value")))
    highest = F.max(F.when(inside, F.col("value")))
    if hinges == "quantile":
        lowest = F.least(F.col("lower_hinge"), lowest)
        highest = F.greatest(F.col("upper_hinge"), highest)
    return measured.groupBy(*groups, *facts).agg(
        lowest.alias("lower_whisker"),
        highest.alias("upper_whisker"),
        F.sum(F.when(inside, F.lit(0.0)).otherwise(F.col("w"))).cast("bigint").alias("n_outliers"),
    ).withColumn("n", F.col("n").cast("bigint"))


def axis_bound(df: DataFrame, groups: Sequence[str], value: str, margin: float = 1.05) -> DataFrame:
    """Upper axis limit for boxplots: highest Tukey whisker, with a margin."""
    return boxplot(df, groups, value, "tukey").agg(
        (F.max("upper_whisker") * margin).alias("axis_max")
    )


def upper_size_bound(quantile: Column, width: float = 10) -> Column:
    return F.ceil(quantile / width) * width


def histogram(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weight: str,
    width: float = 10,
    low: float = 0.5,
    high: Column | None = None,
) -> DataFrame:
    """Counts per right-closed class of ``width`` with a class edge at 0.

    Values outside [low, high] are left out.
    """
    v = F.col(value)
    shown = v >= low if high is None else (v >= low) & (v <= high)
    upper = (F.ceil(v / width) * width).cast("double")
    return (
        df.where(shown)
        .groupBy(*groups, upper.alias("class_max"))
        .agg(F.sum(weight).alias("n_fish"))
        .where(F.col("n_fish") > 0)
        .withColumn("class_min", F.col("class_max") - width)
    )


def share(part: str, whole: str) -> Column:
    return divide(part, whole) * 100
