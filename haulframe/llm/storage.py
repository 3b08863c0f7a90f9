"""Intermediate tables in the folder that all executors share, and broadcasts of counted ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from haulframe.sources import shared
from haulframe.sources.shared import new_path, remove, shared_dir, shuffles_removed

__all__ = [
    "BROADCAST_BYTES", "bounded", "fits", "mostly_in", "new_path", "remove", "remove_stored", "scratch", "shared_dir", "shuffles_removed", "stored",
]

#: Bytes of a counted table that may be broadcast.
BROADCAST_BYTES = 32_000_000
_SLOTS, _WORD = 11, 6  # bits of a place in a row of a filter, and in one of its words

_scratch: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared storage and read back with its own schema."""
    out = shared.stored(df, name)
    if _scratch:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are stored inside, but for those given to the function that it yields."""
    found: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(found)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.pop()
        remove_stored(*(df for df in found if not any(df is k for k in kept)))
        if _scratch:
            _scratch[-1].extend(kept)


def remove_stored(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            remove(df.sparkSession, path)


def _width(kind: T.DataType) -> int:
    """Bytes of a value, about; texts count as keys, which they are in tables that are broadcast."""
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind)
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)) else 32


def fits(df: DataFrame) -> bool:
    """Whether the counted rows of a stored table of rows of fixed width take few bytes."""
    return df.count() * (16 + _width(df.schema)) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """A stored table of rows of fixed width, marked for broadcast if its counted rows take few bytes."""
    return F.broadcast(df) if fits(df) else df


def mostly_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is in the stored ``keys``, with a few others where these are many. Nothing of ``rows`` is shuffled.

    The key is a 64-bit hash. Keys too many for a broadcast are told by a bitmap of 16 bits a key, as far as that can be broadcast: it
    lets through one other row in 16, or more of them where it is full, but never loses a row. A join has to follow.
    """
    keys = keys.select(key)
    if fits(keys):
        return rows.join(F.broadcast(keys), key, "left_semi")
    bits = min(max((16 * keys.count()).bit_length(), _SLOTS), max((6 * BROADCAST_BYTES).bit_length() - 1, _SLOTS))
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = 1 << (_SLOTS - _WORD)
    word = F.shiftright("_slot", _WORD).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = F.expr(f"shiftleft(1L, CAST(_slot & {(1 << _WORD) - 1} AS INT))")
    marked = keys.select(slot.alias("_slot")).select(F.shiftright("_slot", _SLOTS).alias("_row"), word.alias("_word"), bit.alias("_bit"))
    marked = marked.repartition("_row").groupBy("_row").agg(
        F.array(*(F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0).cast("bigint")) for k in range(words))).alias("_words")
    )
    found = rows.withColumn("_slot", slot).withColumn("_row", F.shiftright("_slot", _SLOTS)).join(F.broadcast(marked), "_row")
    return found.where(F.get("_words", word).bitwiseAND(bit) != 0).select(*rows.columns)
