"""Top lists, shares of a total and species order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.joins import match_missing


def largest_first(measure: str, keys: Sequence[str]) -> list[Column]:
    """Descending by measure, then by key; missing values last in both."""
    return [F.col(measure).desc_nulls_last(), *(F.col(k).asc_nulls_last() for k in keys)]


def top_n(df: DataFrame, measure: str, keys: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*largest_first(measure, keys)).limit(n)


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number the rows of a finished, small result in its own order."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def with_total(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Add ``_total.<measure>``: sums over the whole result, as one scalar.

    The scalar reads every measure, so both uses of ``df`` have the same plan
    and the shuffle below them is run once and reused.
    """
    sums = F.struct(*(F.sum(m).alias(m) for m in measures)).alias("_total")
    return df.withColumn("_total", df.agg(sums).scalar())


def percent_of_total(df: DataFrame, measure: str, name: str, totals: Sequence[str]) -> DataFrame:
    """``100 * measure / sum(measure)``; ``totals`` lists all measures of ``df``."""
    share = F.try_divide(F.col(measure) * 100.0, F.col("_total").getField(measure).cast("double"))
    return with_total(df, totals).withColumn(name, share).drop("_total")


def ranked_labels(top: DataFrame, measure: str, keys: Sequence[str], label: str) -> DataFrame:
    """(label, rank) of a top list, without missing labels.

    A label that repeats fails the job, because an order over labels would then
    be ambiguous. The windows only see the list.
    """
    place = F.row_number().over(Window.orderBy(*largest_first(measure, keys)))
    same = F.count(F.lit(1)).over(Window.partitionBy(label))
    repeated = F.raise_error(F.concat(F.lit("label repeats in the top list: "), F.col(label)))
    return (
        top.withColumn("_place", place)
        .where(F.col(label).isNotNull())
        .select(label, F.when(same > 1, repeated.cast("int")).otherwise(F.col("_place")).alias("species_rank"))
    )


def in_label_order(df: DataFrame, ranked: DataFrame, label: str) -> DataFrame:
    """Add ``species_rank``; a label outside the list becomes missing."""
    joined = match_missing(df, ranked.withColumn("_known", F.lit(True)), [label])
    return joined.withColumn(label, F.when(F.col("_known"), F.col(label))).drop("_known")
