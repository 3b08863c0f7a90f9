"""Keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The earliest row (by ``order``) of every distinct key; NULLs are equal.

    A ``min`` over (order, other columns) is combined before the shuffle, so a
    row repeated a billion times sends one row per task, where a ranking window
    would send all copies to one. The leading hash makes the sort-based
    aggregation compare one number in nearly all cases; the full keys still
    decide equality. A key that is also given as order stays a key: it does not
    vary inside a group.
    """
    keys = list(keys)
    order = [o for o in ([order] if isinstance(order, str) else order) if o not in keys]
    others = [c for c in df.columns if c not in keys and c not in order]
    if not order and not others:
        return df.select(*df.columns).distinct()
    first = F.min(F.struct(*order, *others)).alias("_first")
    grouped = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(first)
    return grouped.select(
        *(F.col(c) if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns)
    )


def keep_first_except(df: DataFrame, ignored: Sequence[str], order: str) -> DataFrame:
    """Rows equal in everything but ``ignored`` (and the row position) are one."""
    keys = [c for c in df.columns if c not in ignored and c != order]
    return keep_first(df, keys, order)
