"""Text columns: ids, technique patterns, audit notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haulframe.functions.semantics import as_col, if_else3

NOTE_SEPARATOR = " ; "


def digits_id(c: Column | str) -> Column:
    """Keep the digits of an id and read them as a number; no digit gives NULL."""
    return F.regexp_replace(as_col(c), "[^0-9]", "").try_cast("bigint")


def matches(c: Column | str, pattern: str) -> Column:
    """Case-insensitive pattern search that also folds accented letters."""
    return as_col(c).rlike("(?iu)" + pattern)


def mentions(c: Column | str, text: str) -> Column:
    """Plain substring test; a missing text mentions nothing."""
    return F.coalesce(F.contains(as_col(c), F.lit(text)), F.lit(False))


def add_note(existing: Column | str, note: str, cond: Column) -> Column:
    """Append ``note`` to the audit text where ``cond`` holds.

    An undecidable condition clears the text, because the row can no longer be
    said to be either changed or unchanged.
    """
    existing = as_col(existing)
    # concat_ws leaves out a missing text, and so the separator
    appended = F.concat_ws(NOTE_SEPARATOR, F.nullif(existing, F.lit("")), F.lit(note))
    return if_else3(cond, appended, existing)


def present_label(c: Column | str, present: str = "oui", absent: str = "non") -> Column:
    return F.when(as_col(c).isNull(), F.lit(absent)).otherwise(F.lit(present))


def zone_key(c: Column | str) -> Column:
    """Sub-zone name from a survey label: the part before the first ``" -"``."""
    return F.trim(F.regexp_replace(as_col(c), " -.*", ""))
