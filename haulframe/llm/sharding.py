"""Shards along a Hilbert curve over metadata columns.

Rows that are close in several metadata columns at once get close curve
positions, so each shard covers a small box and readers that filter on any of
the columns skip whole files. Only DataFrame functions are used.

The curve has ``2 ** (bits * columns)`` cells at most, which bounds the tables
of cell counts whatever the input size. A cell may hold most of the rows: places
inside it are given by input partition first, then by row.

Numbers are cut into about equally full classes. Values of a string column keep a class each while
there are no more values than classes; beyond that they share classes in their order, cut by
how many rows lie before a value. Whole values count, whatever beginning they share.

Defined results: a missing value is its own smallest class; a missing text has
no bytes. Repeated rows are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.storage import stored
from haulframe.operators.numbering import in_order


#: Values whose rows are summed up by one task, in powers of two.
_BLOCK = 16


def text_classes(df: DataFrame, name: str, classes: int) -> DataFrame:
    """Values of a string column with their class: ``_value``, ``_class`` (1 to ``classes``, in the order of values)."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = in_order(counts, ["_value"], "_rank").withColumn("_block", F.shiftright("_rank", _BLOCK))
    n_values, n_rows = ordered.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if n_values <= classes:
        return ordered.select("_value", (F.col("_rank") + 1).cast("int").alias("_class"))
    # one row per 65,536 values
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_block").agg(F.sum("_n").alias("_sum")).select(
        "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    here = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.col("_in_block")
    ordered = ordered.withColumn("_in_block", F.coalesce(F.sum("_n").over(here), F.lit(0))).join(starts, "_block")
    return ordered.select("_value", (F.floor(before * classes / n_rows) + 1).cast("int").alias("_class"))


def class_bounds(df: DataFrame, names: Sequence[str], classes: int) -> list[list[float]]:
    """Upper bounds of ``classes`` about equally full classes per column, over all rows."""
    places = [i / classes for i in range(1, classes)]
    row = df.agg(*(F.percentile_approx(n, places, 10_000).alias(f"b{i}") for i, n in enumerate(names))).first()
    return [sorted(set(bounds or ())) for bounds in row]


def class_of(value: Column, bounds: Sequence[float]) -> Column:
    """0 for a missing value, else 1 + the number of bounds below the value."""
    below = [F.when(value > b, 1).otherwise(0) for b in bounds]
    return F.when(value.isNull(), F.lit(0)).otherwise(sum(below, F.lit(0)))


def _bit(value: Column, plane: Column) -> Column:
    return F.call_function("shiftright", value, plane).bitwiseAND(F.lit(1))


def _below(plane: Column) -> Column:
    """All bits below a plane."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), plane) - 1


def with_hilbert_index(cells: DataFrame, axes: Sequence[str], bits: int, name: str) -> DataFrame:
    """Adds the position on the Hilbert curve of the cell with the coordinates ``axes``.

    The usual two steps on the bit planes of the coordinates: undo the turns from
    the highest plane down, then Gray-code the planes and interleave them. The
    state of the first step travels through ``aggregate`` as one array, so the
    expression stays small however many planes there are.
    """
    n = len(axes)

    def turn(x: Column, step: Column) -> Column:
        first, this = F.get(x, F.lit(0)), F.get(x, step["i"])
        odd = _bit(this, step["q"]) == 1
        swap = first.bitwiseXOR(this).bitwiseAND(_below(step["q"]))
        new_first = first.bitwiseXOR(F.when(odd, _below(step["q"])).otherwise(swap))
        new_this = F.when(odd, this).otherwise(this.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when(k == step["i"], new_this).otherwise(v))

    def planes(lowest: int) -> Column:
        order = [(q, i) for q in range(bits - 1, lowest - 1, -1) for i in range(n)]
        return F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in order))

    start = F.array(*(F.col(a).cast("long") for a in axes))
    out = cells.withColumn("_x", F.aggregate(planes(1), start, turn) if bits > 1 else start)
    out = out.withColumn("_g0", F.get("_x", F.lit(0)))
    for i in range(1, n):
        out = out.withColumn(f"_g{i}", F.get("_x", F.lit(i)).bitwiseXOR(F.col(f"_g{i - 1}")))
    last = F.col(f"_g{n - 1}")
    flips = F.lit(0).cast("long")
    for q in range(1, bits):
        flips = flips.bitwiseXOR(F.when(_bit(last, F.lit(q)) == 1, F.lit((1 << q) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("_x", F.array(*(F.col(f"_g{i}") for i in range(n)))).withColumn("_f", flips)
    index = F.aggregate(
        planes(0), F.lit(0).cast("long"),
        lambda h, p: h * 2 + _bit(F.get(F.col("_x"), p["i"]).bitwiseXOR(F.col("_f")), p["q"]),
    )
    return out.withColumn(name, index).drop("_x", "_f", *(f"_g{i}" for i in range(n)))


def along_curve(df: DataFrame, dims: Sequence[str], bits: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of every row with its ``place`` (gapless from 0) on the curve
    and the number of all rows, ``n_rows``.

    The narrow rows are stored once, so that their row ids and the places built on
    them cannot change between evaluations.
    """
    axes = [f"_a{i}" for i in range(len(dims))]
    classes = 2**bits - 1
    texts = {a: d for a, d in zip(axes, dims) if isinstance(df.schema[d].dataType, T.StringType)}
    numbers = {a: d for a, d in zip(axes, dims) if a not in texts}
    keep = list(keep)
    rows = df.select(*keep, *(F.col(d).alias(a) for a, d in texts.items()), *(F.col(d).cast("double").alias(a) for a, d in numbers.items()))
    for a, d in texts.items():
        # stored in value order: Spark knows the size of the table when it plans the join
        values = text_classes(df, d, classes)
        rows = rows.join(values, F.col(a) == F.col("_value"), "left").withColumn(a, F.coalesce("_class", F.lit(0))).drop("_value", "_class")
    rows = stored(rows.withColumn("_uid", F.monotonically_increasing_id()), "curve")
    if numbers:
        bounds = class_bounds(rows, list(numbers), classes)
        rows = rows.withColumns({a: class_of(F.col(a), b) for a, b in zip(numbers, bounds)})
    rows = rows.withColumn("_part", F.call_function("shiftright", F.col("_uid"), F.lit(33)))
    per_part = rows.groupBy(*axes, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2 ** (bits * dims) cells: a bounded table, ranked in one task
    cells = rows.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    cells = with_hilbert_index(cells, axes, bits, "_h")
    on_curve = Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select(*axes, (F.sum("_n").over(on_curve) - F.col("_n")).alias("_cell_start"))
    in_cell = Window.partitionBy(*axes).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        per_part.withColumn("_before", F.sum("_n").over(in_cell) - F.col("_n"))
        .join(cells, axes)
        .select(*axes, "_part", (F.col("_cell_start") + F.col("_before")).alias("_start"))
    )
    # rows of one cell from one input partition: never more than an input partition
    here = Window.partitionBy(*axes, "_part").orderBy("_uid")
    return (
        rows.withColumn("_rank", F.row_number().over(here) - 1)
        .join(starts, [*axes, "_part"])
        .select(
            *keep, (F.col("_start") + F.col("_rank")).cast("long").alias("place"),
            F.lit(rows.count()).cast("long").alias("n_rows"),
        )
    )


def cut_runs(placed: DataFrame, shards: int) -> DataFrame:
    """Cut the curve into ``shards`` runs whose row counts differ by one at most.

    Adds ``shard`` and ``slot`` (place in the shard, gapless from 0).
    """
    cut = placed.withColumn("shard", F.expr(f"cast((place * {shards}) div n_rows as int)"))
    first = F.expr(f"(cast(shard as bigint) * n_rows + {shards - 1}) div {shards}")
    return cut.withColumn("slot", F.col("place") - first)


def hilbert_shards(
    docs: DataFrame, shards: int = 16, dims: Sequence[str] = ("lang", "source", "n_chars"), bits: int = 5,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Shard of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shards differ by one row at most. ``grown_shard`` stays
    NULL, because another shard count moves every cut.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *(F.col(d).alias(f"dim_{i}") for i, d in enumerate(dims)),
    )
    placed = along_curve(rows, [f"dim_{i}" for i in range(len(dims))], bits, ("doc_id", "size", "text_crc32"))
    return cut_runs(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``docs`` joined with their shard, one folder per shard, rows in slot order."""
    (docs.join(sharded.select("doc_id", "shard", "slot"), "doc_id")
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode(mode).partitionBy("shard").parquet(path))
