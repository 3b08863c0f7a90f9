"""Equi-joins in which a missing key matches a missing key.

No join here is hinted. Reference tables are expected to be small, but their
size is left to Spark's broadcast threshold and to adaptive execution, so a
table that outgrows it is joined by a shuffle instead of failing an executor.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_missing(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the left keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_match_{k}" for k in keys})
    on = reduce(
        lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_match_{k}")) for k in keys)
    )
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(
        *(f"_match_{k}" for k in keys)
    )


def with_dimension(
    df: DataFrame, dimension: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Add ``columns`` of the distinct dimension rows; unmatched rows stay.

    A key with several distinct dimension rows multiplies its declarations.
    """
    return match_missing(df, dimension.select(*keys, *columns).distinct(), keys)


def present_in(df: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``active``.

    The keys are made distinct first, which combines them before the shuffle: a
    key that holds most of the active rows sends one row per task.
    """
    return match_missing(df, active.select(*keys).distinct(), keys, "left_semi")
