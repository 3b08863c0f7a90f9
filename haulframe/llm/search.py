"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners, rarest first. An owner is a table of postings of
its terms, cut into blocks of documents. A bundle is what the items have gathered in one block:
a sparse list of (item, document, score). Bundles start empty and go from owner to owner; each
cogroup by block adds the contributions of the owner's terms, as whole numbers. The last
owner's stage picks the best of every item in its block, and a window the best of all blocks.

Owners grow geometrically: an owner holds ``GROWTH`` times the contributions of the one before,
so that bundles are thin as long as they travel, and the common terms, which touch nearly every
document, are added where nothing travels any more.

Nothing grows with the corpus but the number of blocks: a block has at most ``CELLS`` /
items documents and ``BLOCK_BYTES`` of text, the driver and the workers hold the terms of a chunk of items
(``MAX_TERMS``; more items are searched in several chunks).

Score: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's length counts as
m = 10 + 90 * n * N div L, and a document scores the sum of weight * (10^9 * tf div (1000 * tf + 8 * m))
over the item's distinct terms. N counts documents with a term, L their terms.

Defined results: a missing or empty text has no term and is never found. Every row of the documents
is one, also where ids repeat; a missing id ranks behind all others of its score. Rows of items with the same
id and text are one item; the same id with another text is an item of its own. An item without
terms, or whose terms no document has, gives no row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.numtext import parts
from haulframe.llm.storage import new_path, stored

OWNERS = 4
GROWTH = 10
CELLS = 1 << 20  # items x documents of a block
BLOCK_BYTES = 4_000_000  # of text
MAX_TERMS = 500_000  # of a chunk of items

# bytes that are not of a term become blanks, A-Z become a-z
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _term_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, terms): the distinct items with their distinct terms, stored."""
    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").cast("binary").alias("text")).where(
        F.col("text").isNotNull()
    ).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    schema = T.StructType([rows.schema["item"], T.StructField("terms", T.ArrayType(T.BinaryType()))])
    return stored(rows.mapInArrow(cut, schema).where(F.size("terms") > 0), "items")


class _Postings:
    """Postings of the known terms in some texts: code, document (its place) and tf, sorted by code."""

    def __init__(self, texts: list[bytes | None], known: dict[bytes, int]):
        words = [terms_of(t) if t else [] for t in texts]
        self.n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        get = known.get
        code = np.concatenate([
            np.fromiter(map(get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in words
        ] or [np.zeros(0, dtype=np.int64)])
        at = np.repeat(np.arange(len(words)), self.n)[code >= 0]
        key, self.tf = np.unique(code[code >= 0] * max(len(words), 1) + at, return_counts=True)
        self.code, self.at = np.divmod(key, max(len(words), 1))


def _blocks(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text", size=BLOCK_BYTES):
        for begin in range(0, batch.num_rows, docs):
            yield batch.slice(begin, docs)


def _statistics(rows: DataFrame, known: dict[bytes, int], docs: int) -> tuple[int, int, np.ndarray]:
    """N, L and the df of every known term. Each task adds up its own before anything leaves it."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 2, dtype=np.int64)
        for block in _blocks(batches, docs):
            p = _Postings(block.column("text").to_pylist(), known)
            total[:-2] += np.bincount(p.code, minlength=len(known))
            total[-2:] += (p.n > 0).sum(), p.n.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "count"])

    sums = np.zeros(len(known) + 2, dtype=np.int64)
    for code, count in rows.select("text").mapInArrow(counted, "code bigint, count bigint").groupBy("code").agg(F.sum("count")).collect():
        sums[code] = count
    return int(sums[-2]), int(sums[-1]), sums[:-2]


def owners_of(df: np.ndarray, uses: np.ndarray, owners: int, growth: int) -> np.ndarray:
    """The owner of every term: rarest terms first, each owner with ``growth`` times the contributions before it."""
    work = df * uses
    order = np.lexsort((np.arange(len(df)), work))
    done = np.cumsum(work[order]) / max(int(work.sum()), 1)
    limits = np.array([growth ** -float(owners - 1 - i) for i in range(owners - 1)])
    out = np.empty(len(df), dtype=np.int64)
    out[order] = np.searchsorted(limits, done, "left")
    return out


def _write_owners(rows: DataFrame, known: dict[bytes, int], owner: np.ndarray, owners: int, docs: int, path: str) -> None:
    """One table per owner: a row for every block with its documents' lengths and the postings.

    Documents' ids are kept with the last owner.
    """
    id_type = pa.list_(rows.select("id").limit(0).toArrow().schema.field("id").type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 33
        for number, block in enumerate(_blocks(batches, docs)):
            p = _Postings(block.column("text").to_pylist(), known)
            of = owner[p.code]
            packed = lambda a, kind: a.astype(kind).tobytes()
            columns = {"code": "<u4", "at": "<u4", "tf": "<u4"}
            mine = [of == k for k in range(owners)]
            yield pa.RecordBatch.from_arrays([
                pa.array([task + number] * owners), pa.array(list(range(owners)), pa.int32()),
                pa.array([None] * (owners - 1) + [block.column("id").to_pylist()], id_type),
                pa.array([packed(p.n, "<i8")] * owners, pa.binary()),
                *(pa.array([packed(getattr(p, c)[m], kind) for m in mine], pa.binary()) for c, kind in columns.items()),
            ], ["block", "owner", "docs", "n", *columns])

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("owner", T.IntegerType()),
        T.StructField("docs", T.ArrayType(rows.schema["id"].dataType)),
        *(T.StructField(c, T.BinaryType()) for c in ("n", "code", "at", "tf")),
    ])
    rows.mapInArrow(cut, schema).write.partitionBy("owner").parquet(path)


def _best(ids: list, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties by id, missing ids last."""
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
    order = sorted(found.tolist(), key=lambda i: (-score[i], ids[i] is None, 0 if ids[i] is None else ids[i]))
    return np.array(order[:k], dtype=np.int64)


class _Stage:
    """What an owner does with the bundles of a block."""

    def __init__(self, n_docs: int, length: int, weights: np.ndarray, item_terms: list[np.ndarray]):
        self.n_docs, self.length, self.weights, self.item_terms = n_docs, length, weights, item_terms

    def scores(self, bundle: dict, postings: dict) -> Iterator[tuple[int, np.ndarray]]:
        """(item, scores of all documents of the block) of items that have any."""
        n, code, at, tf = (np.frombuffer(postings[c], dtype=d).astype(np.int64) for c, d in (("n", "<i8"), ("code", "<u4"), ("at", "<u4"), ("tf", "<u4")))
        m = 10 + (90 * n * self.n_docs) // self.length if self.length else np.zeros(len(n), dtype=np.int64)
        more = self.weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
        item, place, score = (np.frombuffer(bundle[c], dtype=d) for c, d in (("item", "<u4"), ("at", "<u4"), ("score", "<i8")))
        cut = np.searchsorted(item, np.arange(len(self.item_terms) + 1))
        for i, terms in enumerate(self.item_terms):
            low, high = np.searchsorted(code, terms), np.searchsorted(code, terms, "right")
            with_any = np.flatnonzero(high > low).tolist()
            if cut[i] == cut[i + 1] and not with_any:
                continue
            total = np.zeros(len(n), dtype=np.int64)
            total[place[cut[i]:cut[i + 1]]] = score[cut[i]:cut[i + 1]]
            for t in with_any:
                total[at[low[t]:high[t]]] += more[low[t]:high[t]]  # a document is once in a term's postings
            yield i, total

    def passed_on(self, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, postings = left.to_pylist()[0], right.to_pylist()[0]
        items, places, scores = [], [], []
        for i, total in self.scores(bundle, postings):
            at = np.flatnonzero(total)
            items.append(np.full(len(at), i, dtype="<u4"))
            places.append(at.astype("<u4"))
            scores.append(total[at])
        whole = lambda a, kind: np.concatenate(a or [np.zeros(0)]).astype(kind).tobytes()
        return pa.table({
            "block": [bundle["block"]], "item": pa.array([whole(items, "<u4")], pa.binary()),
            "at": pa.array([whole(places, "<u4")], pa.binary()), "score": pa.array([whole(scores, "<i8")], pa.binary()),
        })

    def chosen(self, k: int, kind: pa.DataType, left: pa.Table, right: pa.Table) -> pa.Table:
        bundle, postings = left.to_pylist()[0], right.to_pylist()[0]
        item, doc, score = [], [], []
        for i, total in self.scores(bundle, postings):
            best = _best(postings["docs"], total, k)
            item += [i] * len(best)
            doc += [postings["docs"][j] for j in best]
            score += total[best].tolist()
        return pa.table({"item": pa.array(item, pa.int64()), "id": pa.array(doc, kind), "score": pa.array(score, pa.int64())})


_BUNDLE = "block bigint, item binary, at binary, score binary"


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = 10, owners: int = OWNERS, growth: int = GROWTH, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """(item, rank, doc, score): the k documents of highest score above 0 of every item, under the names of the ids' columns."""
    spark = docs.sparkSession
    terms = _term_table(items, item_id, item_text)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    chunks = -(-total // max_terms)
    turn = F.pmod(F.xxhash64("item", "terms"), F.lit(max(chunks, 1)))
    names = [item_id, "rank", doc_id, "score"]
    if item_id == doc_id:
        raise ValueError("give the ids of items and documents different names")
    found = [_search_chunk(rows, terms.where(turn == c), k, owners, growth) for c in range(chunks)]
    if not found:
        schema = T.StructType([
            T.StructField(names[0], items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(names[2], docs.schema[doc_id].dataType), T.StructField("score", T.LongType()),
        ])
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.toDF(*names)


def _search_chunk(rows: DataFrame, terms: DataFrame, k: int, owners: int, growth: int) -> DataFrame:
    spark = rows.sparkSession
    asked = sorted(((r["item"], [bytes(t) for t in r["terms"]]) for r in terms.collect()), key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1]))
    known: dict[bytes, int] = {}
    item_terms = [np.array(sorted(known.setdefault(t, len(known)) for t in ts), dtype=np.int64) for _, ts in asked]
    per_block = max(CELLS // max(len(asked), 1), 64)
    n_docs, length, df = _statistics(rows, known, per_block)
    weights = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
    owner = owners_of(df, np.bincount(np.concatenate([*item_terms, np.zeros(0, dtype=np.int64)]), minlength=len(known)), owners, growth)
    path = new_path(spark, "postings")
    _write_owners(rows, known, owner, owners, per_block, path)
    read = spark.read.parquet(path) if n_docs else None
    if read is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item", terms.schema["item"].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType()),
        ]))
    stage = _Stage(n_docs, length, weights, item_terms)
    of = lambda i: read.where(F.col("owner") == i)
    none = F.lit(b"").cast("binary")
    bundles = of(0).select("block", none.alias("item"), none.alias("at"), none.alias("score"))
    for i in range(owners - 1):
        posted = of(i).select("block", "n", "code", "at", "tf")
        bundles = bundles.groupBy("block").cogroup(posted.groupBy("block")).applyInArrow(lambda left, right: stage.passed_on(left, right), _BUNDLE)
    kind = rows.select("id").limit(0).toArrow().schema.field("id").type
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType())])
    last = of(owners - 1).select("block", "docs", "n", "code", "at", "tf")
    best = bundles.groupBy("block").cogroup(last.groupBy("block")).applyInArrow(
        lambda left, right: stage.chosen(k, kind, left, right), schema
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], T.StructType([
        T.StructField("item", T.LongType()), T.StructField("name", terms.schema["item"].dataType)
    ]))
    return ranked.join(F.broadcast(ids), "item").select(F.col("name").alias("item"), "rank", "id", "score")
