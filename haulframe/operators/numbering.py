"""Consecutive numbers in the order of a key, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulframe.sources.shared import stored

_PLACE_BITS = 33  # of an id that Spark gives: the task above, the place in it below


def in_order(df: DataFrame, order: Sequence, number: str = "number") -> DataFrame:
    """``df`` with its row numbers (from 0) in the given order, as a stored table.

    Rows are dealt to tasks by ranges of the order and sorted there; a row's number is its place in its task plus
    the sizes of the tasks before. The one step in a single task is the running sum of those
    sizes, one row per task. The dealt rows are written first: which task a row went to, and so
    its number, does not change when an executor is lost later.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    task = F.shiftright("_at", _PLACE_BITS).alias("_task")
    sizes = dealt.groupBy(task).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    rows = dealt.withColumn("_task", task).join(F.broadcast(starts), "_task")  # as many rows as there were tasks
    return rows.withColumn(number, F.col("_before") + place).select(*df.columns, number)
