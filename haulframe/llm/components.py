"""Connected components: union-find as rounds of joins.

Each round lets every vertex point its larger neighbours, then its smaller ones, to the
smallest vertex that it knows, until every component is a star around its smallest
vertex. A round's minimum is combined before its shuffle; it is stored before it is
joined, so that a vertex with very many neighbours can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.storage import bounded, remove_stored, stored


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has an edge; the component is its smallest id."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = stored(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        # larger neighbours go to the smallest vertex known
        large = both.where(F.col("v") > F.col("u")).join(bounded(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large, "large")
        # then smaller neighbours do
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(bounded(low), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove_stored(last, lowest, large, low)
        before, seen = seen, _print(now)
        if before == seen:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
