"""Key figures under any selection of years, months, zones and modes, from one small table.

Distinct counts do not add up, but bitmaps do: outings and anglers get dense numbers, and every cell (year,
month, zone, mode) holds the bitmaps of its numbers. A selection merges the bitmaps of its cells and counts
bits; declarations are not read again. Outings are numbered cell by cell, so a cell's outings fill few
bitmaps of 4 kB, one per 32,768 outings and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.semantics import sum0
from haulframe.operators.joins import match_missing
from haulframe.operators.numbering import in_order
from haulframe.sources import columns as C
from haulframe.sources.shared import stored

CELL = (C.YEAR, C.MONTH_NUMBER, C.ZONE, C.MODE)


def _bitmaps(numbered: DataFrame, kind: str) -> DataFrame:
    n = F.col("_number") + 1  # bit positions begin with 1
    cells = numbered.groupBy("_cell", F.bitmap_bucket_number(n).alias("bucket"))
    return cells.agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits")).withColumn("kind", F.lit(kind))


def selectable(df: DataFrame) -> DataFrame:
    """The table of cells: year, month, zone, mode, kind (outing, fruitless, angler or catch), bucket, bits, caught. Stored.

    A missing angler, outing, zone or mode is a value like any other.
    """
    # an outing's 128-bit digest and the number of its cell are what is shuffled from here on
    outing = F.unhex(F.md5(F.col(C.OUTING).cast("binary"))).alias("_outing")
    pairs = stored(df.groupBy(*CELL, outing, C.ANGLER).agg(sum0(C.CATCHES).alias("_catch")), "pairs")
    codes = in_order(pairs.select(*CELL).distinct(), CELL, "_cell")
    coded = match_missing(pairs, codes, CELL).select("_cell", "_outing", C.ANGLER, "_catch")
    per_cell = coded.groupBy("_outing", "_cell").agg(F.sum("_catch").alias("_catch"))
    # an outing of several cells has one number, by its first cell
    per_outing = per_cell.groupBy("_outing").agg(F.min("_cell").alias("_first"), F.collect_list(F.struct("_cell", "_catch")).alias("_in"))
    placed = per_outing.select("_first", F.xxhash64("_outing").alias("_at_random"), "_in")
    numbered = in_order(placed, ["_first", "_at_random"], "_number").select("_number", F.inline("_in"))
    people = in_order(coded.select(C.ANGLER).distinct(), [C.ANGLER], "_number")
    by_angler = match_missing(coded.select("_cell", C.ANGLER).distinct(), people, [C.ANGLER])
    caught = coded.groupBy("_cell").agg(F.sum("_catch").alias("caught")).withColumn("kind", F.lit("catch"))
    table = _bitmaps(numbered, "outing").unionByName(_bitmaps(numbered.where(F.col("_catch") == 0), "fruitless"))
    table = table.unionByName(_bitmaps(by_angler, "angler")).unionByName(caught, allowMissingColumns=True)
    return stored(table.join(codes, "_cell").drop("_cell"), "cells")


def _merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    merged = cells.groupBy(*keys, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("caught").alias("caught"))
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0)).cast("bigint")
    return merged.groupBy(*keys).agg(
        count("angler").alias("n_anglers"), count("outing").alias("n_outings"), count("fruitless").alias("n_fruitless"),
        sum0("caught").alias("total_catch"),
    )


def figures(cells: DataFrame, selected: Column | None = None) -> DataFrame:
    """n_anglers, n_outings, n_fruitless and total_catch of the selected cells, in one row."""
    return _merged(cells if selected is None else cells.where(selected), [])


def figures_by(cells: DataFrame, key: str, selected: Column | None = None) -> DataFrame:
    """The same per year, month, zone or mode."""
    return _merged(cells if selected is None else cells.where(selected), [key])
