"""Calendar parts of the session start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulframe.functions.semantics import as_col

# Labels that appear in results.
MONTHS = (
    "janvier", "février", "mars", "avril", "mai", "juin",
    "juillet", "août", "septembre", "octobre", "novembre", "décembre",
)
WEEKDAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def _label(labels: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), position)


def weekday_label(ts: Column | str) -> Column:
    return _label(WEEKDAYS, F.weekday(as_col(ts)) + 1)


def month_number(ts: Column | str) -> Column:
    return F.month(as_col(ts))


def month_label(ts: Column | str) -> Column:
    return _label(MONTHS, F.month(as_col(ts)))


def month_label_of_number(number: Column | str) -> Column:
    return _label(MONTHS, as_col(number))
