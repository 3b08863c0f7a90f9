"""Outings: same angler, session start, fishing mode and zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.operators.joins import match_missing
from haulframe.operators.numbering import in_order
from haulframe.sources import columns as C

KEY = (C.ANGLER, C.SESSION, C.MODE, C.ZONE)
BUCKET_DIGITS = 4  # 16^4 buckets of evenly spread digests


def outing_key(parts: Sequence[str] = KEY) -> Column:
    """Digest of the outing's key; a missing part is a value of its own.

    Only equality of outing ids matters, so the id is computed row by row
    instead of by ranking all keys.
    """
    return F.md5(key_text(parts))


def _packed(key: str) -> Column:
    """A digest in half its length and in the same order; any other text in bytes that no digest has."""
    c = F.col(key)
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.unhex(c)).otherwise(F.concat(c.cast("binary"), F.lit(bytes(17))))


def _unpacked() -> Column:
    p = F.col("_packed")
    return F.when(F.length(p) == 16, F.lower(F.hex(p))).otherwise(F.substr(p, F.lit(1), F.length(p) - 17).cast("string"))


def _label(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("S"), F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0")))


def _placed(packed: DataFrame) -> DataFrame:
    """Distinct values of ``_packed`` with their numbers from 1."""
    keys = packed.select("_packed").distinct()
    bucket = F.substring("_packed", 1, BUCKET_DIGITS // 2)
    sizes = keys.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_size"))
    up_to = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("_bucket", (F.sum("_size").over(up_to) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_packed"))
    placed = match_missing(keys.withColumn("_bucket", bucket).withColumn("_place", place), starts, ["_bucket"])
    return placed.select("_packed", (F.col("_before") + F.col("_place")).alias("_number"))


def numbered(df: DataFrame, key: str = C.OUTING) -> DataFrame:
    """Distinct outings with consecutive labels ``S000001``, ``S000002``, ...

    The digests fall evenly into buckets by their leading digits; an outing's
    number is its place in the bucket plus the size of the buckets before. The
    bucket sizes are the only thing seen by a single task.
    """
    return with_outing_labels(df.select(key).distinct(), key)


def with_outing_labels(df: DataFrame, key: str = C.OUTING) -> DataFrame:
    """Every row with the label of its outing. Digests are shuffled in 16 bytes, and numbers instead of labels."""
    packed = df.withColumn("_packed", _packed(key)).drop(key)
    found = match_missing(packed, _placed(packed), ["_packed"])
    return found.select(*(_unpacked().alias(c) if c == key else c for c in df.columns), _label(F.col("_number")).alias("outing_label"))


def key_text(parts: Sequence[str] = KEY) -> Column:
    """The outing's key as a text; a missing part is ``NA``."""
    return F.concat_ws("_", *(F.coalesce(F.col(p).cast("string"), F.lit("NA")) for p in parts))


def numbered_by_key(df: DataFrame, parts: Sequence[str] = KEY) -> DataFrame:
    """(outing_key, outing_number, outing_label): outings numbered from 1 in the order of their keys' texts. Stored.

    The order is that of the UTF-8 bytes. Distinct keys are dealt by ranges, so no task ranks more than its own.
    """
    keys = in_order(df.select(key_text(parts).alias("outing_key")).distinct(), ["outing_key"], "_number")
    number = F.col("_number") + 1
    return keys.select("outing_key", number.alias("outing_number"), _label(number).alias("outing_label"))


def with_numbers_by_key(df: DataFrame, parts: Sequence[str] = KEY) -> DataFrame:
    return df.withColumn("outing_key", key_text(parts)).join(numbered_by_key(df, parts), "outing_key", "left")
