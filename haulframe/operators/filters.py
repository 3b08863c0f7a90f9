"""Row selections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.sources import columns as C


def _midnight(day: str) -> Column:
    """Zone-less, so neither Python's nor the session's time zone matters."""
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def since(df: DataFrame, day: str, ts: str = C.SESSION) -> DataFrame:
    """Rows that start on or after ``day``; rows without a start are dropped."""
    return df.where(F.col(ts) >= _midnight(day))


def in_year(df: DataFrame, year: int | None, ts: str | None = None) -> DataFrame:
    """One year, or everything for ``None``.

    On cleaned tables the ``annee`` partition column is compared, which prunes
    directories. With ``ts`` the year becomes a range on that timestamp, which
    reaches the file scan as a pushed filter.
    """
    if year is None:
        return df
    if ts is None:
        return df.where(F.col(C.YEAR) == year)
    return df.where(
        (F.col(ts) >= _midnight(f"{year:04d}-01-01")) & (F.col(ts) < _midnight(f"{year + 1:04d}-01-01"))
    )


def in_months(df: DataFrame, months: Iterable[str], column: str = C.MONTH) -> DataFrame:
    months = list(months)
    if not months:
        raise ValueError("choose at least one month")
    return df.where(F.col(column).isin(months))


def of_mode(df: DataFrame, mode: str, column: str = C.MODE) -> DataFrame:
    return df.where(F.col(column) == mode)


def determinable_mode(
    df: DataFrame, undetermined: str = "Indeterminable", column: str = C.MODE
) -> DataFrame:
    """Drops the undetermined mode, and rows without a mode."""
    return df.where(F.col(column) != undetermined)


def of_species(df: DataFrame, name: str, column: str = C.VERNACULAR) -> DataFrame:
    return df.where(F.col(column) == name)


def sized(df: DataFrame, column: str = C.SIZE) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def plausible_singles(df: DataFrame, margin: float = 1.2) -> DataFrame:
    """Single-fish lines whose size and weight stay within the known maxima."""

    def within(value: str, limit: str):
        return (F.col(value) <= F.col(limit) * margin) | F.col(limit).isNull()

    return df.where(
        (F.col(C.CATCHES) == 1) & within(C.SIZE, C.SIZE_MAX) & within(C.WEIGHT, C.WEIGHT_MAX)
    )
