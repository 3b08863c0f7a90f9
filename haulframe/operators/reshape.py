"""Row generation and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_count(c: Column) -> Column:
    """A repeat count as INT; negative or fractional counts fail the job."""
    bad = (c < 0) | (c != F.floor(c))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a repeat count: "), c.cast("string"))).cast("int")).otherwise(
        c.cast("int")
    )


BLOCK = 1024


def uncount(df: DataFrame, weight: str) -> DataFrame:
    """One row per counted item; the count column is dropped, count 0 vanishes.

    Rows are generated block by block, so no array grows with the count. The
    statistics in this package never need this operator: they take the count as
    a weight, so the table is not multiplied.
    """
    kept = [c for c in df.columns if c != weight]
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1, F.lit(BLOCK)))
    size = F.least(F.lit(BLOCK), F.col("_n") - F.col("_start"))
    return (
        df.where(F.col(weight).isNotNull())
        .select(*kept, whole_count(F.col(weight)).alias("_n"))
        .withColumn("_start", F.explode(starts))
        .select(*kept, F.explode(F.array_repeat(F.lit(0), size)).alias("_item"))
        .drop("_item")
    )


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def add_steps(df: DataFrame, limit: str, step: float, name: str) -> DataFrame:
    """One row for each of 0, step, 2*step, ... up to the row's ``limit``.

    A row without a limit, or with a negative one, gives no rows.
    """
    last = F.floor(F.col(limit) / step).cast("int")
    return (
        df.where(F.col(limit) >= 0)
        .withColumn(name, F.explode(F.sequence(F.lit(0), last)))
        .withColumn(name, F.col(name) * F.lit(float(step)))
    )
