"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its shingles. Documents with equal sets are one item. Every
item walks down independent trees, each with MinHash numbers of its own for each level: a node chooses among those and its
items go on by the numbers they have there, so that similar items stay together and others
part. Nodes that are still large after the first levels branch on while that parts them, as `links` says;
small nodes are compared exhaustively. Each link is confirmed on the full sets.

With the defaults a pair at the least similarity that meets in small nodes is missed by all trees with a chance of
about 1 in 7 million. Nodes that branch on lose some: 1 in 40,000 after four more levels, 1 in 5,000 after twelve, and
of pairs at 0.85 less than 1 in 800,000 (simulated with numbers that do not depend on which nodes give way). The signatures pass over 1 pair in 300,000 at most.

Defined results: a text without words has an empty set, no links, and is its own
component. The smallest id of a component names it, missing ids count as largest; rows
with the same id and text are one document and get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.links import similar_components
from haulframe.llm.minhash import CHOICES, branch, leaves, signatures
from haulframe.llm.numtext import CHUNK, LOWER, Words, chunks, parts
from haulframe.llm.storage import bounded, remove_stored, stored

TREES = 16
#: Levels before the members of nodes are counted for the first time; nodes above are large in any large corpus.
DEPTH = 3
#: Chance of a second child below these levels: a pair at 0.8 is expected in 1.2 children, one at 0.65 in 0.98.
MORE = 0.5


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    out: list[np.ndarray] = []
    none = np.zeros(0, dtype=np.uint64)
    for _, some in chunks(texts):
        w = Words(some, LOWER)
        runs, at = w.runs(words)
        bounds = np.searchsorted(w.doc[at], np.arange(len(some) + 1))
        n = w.per_doc(slice(None))
        sets = [np.unique(runs[a:b]) for a, b in zip(bounds, bounds[1:])]
        for size in range(1, words):
            if (n == size).any():
                short, first = w.runs(size)
                # the only run of a text with just so many words
                for h, d in zip(short, w.doc[first]):
                    if n[d] == size:
                        sets[d] = np.array([h], dtype=np.uint64)
        out += [s if len(s) else none for s in sets]
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def facts(docs: DataFrame, doc_id: str, text: str, words: int, k: int) -> DataFrame:
    """Per row: doc_id, key (of its text), n_shingles, digest (of its set), sig."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def described(batches):
        for batch in parts(batches, "text", size=CHUNK):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = n > 0
            flat = np.concatenate([s for s in sets if len(s)]) if full.any() else np.zeros(0, dtype=np.uint64)
            sig = signatures(flat, (np.cumsum(n) - n)[full], k)
            of_full = iter(sig)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array(n),
                pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()),
                pa.array([next(of_full).tobytes() if f else None for f in full], pa.binary()),
            ], ["doc_id", "key", "n_shingles", "digest", "sig"])

    return rows.mapInArrow(described, f"doc_id {kind}, key binary, n_shingles bigint, digest binary, sig binary")


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)


def _leaves(items: DataFrame, trees: int, depth: int, similarity: float) -> DataFrame:
    def walked(batches):
        for batch in batches:
            if batch.num_rows:
                row, node, tree = leaves(_signatures(batch), trees, depth, similarity)
                yield pa.RecordBatch.from_arrays([
                    pa.array(node.view(np.int64)), batch.column("rid").take(pa.array(row)), pa.array(tree.astype(np.int32))
                ], ["node", "rid", "tree"])

    return items.select("rid", "sig").mapInArrow(walked, "node bigint, rid bigint, tree int")


def _children(members: DataFrame, elements: DataFrame, level: int, trees: int) -> DataFrame:
    """Members (node, rid, component, tree) one level down by fresh numbers: parent, node, rid, component, tree.

    ``elements`` (rid, elements) has their sets; no set is empty.
    """
    def drawn(batches):
        for batch in parts(batches, "elements", size=CHUNK):
            found = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column("elements")]
            if found:
                n = np.array([len(x) for x in found], dtype=np.int64)
                sig = signatures(np.concatenate(found), np.cumsum(n) - n, trees * CHOICES, draw=level)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([x.tobytes() for x in sig], pa.binary())], ["rid", "sig"])

    def walked(batches):
        for batch in batches:
            if batch.num_rows:
                parent = batch.column("node").to_numpy()
                tree = batch.column("tree").to_numpy().astype(np.int64)
                row, node, tree = branch(_signatures(batch), np.arange(batch.num_rows), parent.view(np.uint64), tree, MORE)
                yield pa.RecordBatch.from_arrays([
                    pa.array(parent[row]), pa.array(node.view(np.int64)), batch.column("rid").take(pa.array(row)),
                    batch.column("component").take(pa.array(row)), pa.array(tree.astype(np.int32)),
                ], ["parent", "node", "rid", "component", "tree"])

    sigs = stored(elements.mapInArrow(drawn, "rid bigint, sig binary"), "numbers")
    return members.join(sigs, "rid").select("node", "rid", "component", "tree", "sig").mapInArrow(
        walked, "parent bigint, node bigint, rid bigint, component bigint, tree int"
    )


def grouped(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
    trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """As `near_duplicates`, with ``group``, which is equal for rows of one component and missing without words."""
    k = trees * depth * CHOICES
    seen = stored(facts(docs, doc_id, text, words, k), "facts")
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    items = seen.where(F.col("n_shingles") > 0).groupBy("digest").agg(
        F.min(named).alias("first"), F.min("key").alias("key"), F.any_value("sig").alias("sig")
    )
    items = stored(items.withColumn("rid", F.monotonically_increasing_id()), "items")

    def texts(ids: DataFrame) -> DataFrame:
        keys = stored(items.join(bounded(ids), "rid").select("rid", F.col("key").alias("_key")), "keys")
        rows = docs.select(text_key(F.col(text)).alias("_key"), F.col(text).cast("string").cast("binary").alias("text"))
        # copies are combined before the shuffle
        return rows.join(bounded(keys), "_key").groupBy("rid").agg(F.any_value("text").alias("text"))

    def sets(found: list[bytes]) -> list[np.ndarray]:
        return shingle_sets(found, words)

    def children(members: DataFrame, elements: DataFrame, level: int) -> DataFrame:
        return _children(members, elements, level, trees)

    similarity = percent / 100
    components = similar_components(_leaves(items, trees, depth, similarity), items, texts, sets, percent, k, children)
    classed = items.join(components, F.col("rid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rid"))
    names = stored(classed.groupBy("component").agg(F.min("first").alias("name")), "names")
    by_set = stored(classed.select("digest", "component").join(names, "component").select(
        "digest", F.col("component").alias("group"), F.col("name.doc_id").alias("component_id")
    ), "sets")
    alone = F.col("n_shingles") == 0
    return (
        seen.drop("sig").join(by_set, "digest", "left")
        .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "group")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
    trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """Per row: doc_id, key (MD5 of the text), n_shingles, component_id, kept (doc_id is component_id)."""
    return grouped(docs, doc_id, text, words, percent, trees, depth).drop("group")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    Of rows with the same id and text one stays; ids may repeat or be missing.
    """
    found = grouped(docs, doc_id, text, words, percent).select("doc_id", "key", "group")
    found = stored(found, "found")
    # the row that stays: the smallest id, missing ones last, then the smallest key
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    firsts = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = stored(firsts.where(F.col("first") != F.col("last")).select("group", "first"), "firsts")
    dropped = found.join(bounded(firsts), "group").where(place != F.col("first"))
    rename = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    dropped = stored(rename(dropped).distinct(), "dropped")
    repeated = stored(rename(found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "repeated")
    remove_stored(found, firsts)
    keyed = docs.withColumn("_near_key", text_key(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_near_key") == F.col("_key"))
    out = keyed.join(bounded(dropped), same, "left_anti")
    if repeated.isEmpty():
        return out.drop("_near_key")
    once = out.join(bounded(repeated), same, "left_semi").groupBy(doc_id, "_near_key").agg(
        F.any_value(F.struct(*docs.columns)).alias("_row")
    ).select("_row.*")
    return out.join(bounded(repeated), same, "left_anti").drop("_near_key").unionByName(once)
