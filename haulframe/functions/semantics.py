"""Missing-value semantics shared by every operator.

A declaration export is full of gaps, and the rules are written for a
three-valued world that differs from Spark's defaults in a few places: a
condition that cannot be decided yields a missing value instead of the "else"
branch, "not in a list" is true for a missing value, a sum over nothing is
zero, and a missing value counts as one distinct value.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else3(cond: Column, yes, no) -> Column:
    """``yes`` / ``no``, and NULL when the condition is unknown."""
    return F.when(cond, yes).when(~cond, no)


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    return ~is_in(c, values)


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def power(base: Column | str, exponent: Column | str) -> Column:
    """``base ^ exponent``; 1 to an unknown power is 1 and NaN becomes NULL."""
    base, exponent = as_col(base), as_col(exponent)
    return F.when(base == 1, F.lit(1.0)).otherwise(nan_to_null(F.pow(base, exponent)))


def divide(a: Column | str, b: Column | str) -> Column:
    """Division where a zero divisor gives NULL instead of an error."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def sum0(c: Column | str) -> Column:
    """Sum that ignores missing values and is 0 over none."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def n_distinct(c: Column | str) -> Column:
    """Number of distinct values; missing counts as one value."""
    c = as_col(c)
    return F.count_distinct(c) + F.coalesce(
        F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0)
    )


def first_by(c: Column | str, order: Column | str) -> Column:
    """Value on the earliest row; a NULL there is kept as NULL."""
    return F.min_by(as_col(c), as_col(order))


def count_present(*cols: Column | str) -> Column:
    """How many of the given columns hold a value, per row."""
    return sum((as_col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def count_equal(value, *cols: Column | str) -> Column:
    """How many of the given columns equal ``value``, per row."""
    return sum(
        (F.coalesce((as_col(c) == value).cast("int"), F.lit(0)) for c in cols),
        F.lit(0),
    )
