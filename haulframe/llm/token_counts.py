"""Token counts by a two-tier lookup.

A SentencePiece BPE vocabulary in which a space mark only opens a piece, and in which
no piece holds a line break, never merges across these places. A text is therefore cut
there into pre-tokens whose counts add up. The most frequent pre-tokens and their counts
travel to every worker as one small table. Other pre-tokens are encoded where they
occur and remembered in the worker, so no pre-token is ever shuffled.

The frequent ones are found over all rows: each partition keeps a bounded summary of
what it read (rare entries are dropped when it is full), and only the summaries are
added up. The table changes the speed, never a count.

Memory: the table holds ``table_size`` entries at most; a worker keeps it with at most
``CACHE`` entries of its own, then starts again from the table. A pre-token longer
than ``LONG`` characters is encoded without being remembered.

Defined results: a missing text is empty, an empty text has no tokens. Repeated rows
get a row each. Special strings inside texts are ordinary text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.numtext import CHUNK, parts

TABLE = 131_072
SUMMARY = 131_072
CACHE = 400_000
LONG = 256
MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


_models: dict[bytes, object] = {}


def load(model: bytes):
    """The processor for a model file's content, made once per worker process."""
    import sentencepiece

    if model not in _models:
        _models[model] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _models[model]


def splits_exactly(processor) -> bool:
    """Whether counts of pre-tokens add up for this vocabulary (see above).

    The model must leave texts as they are, but for marking spaces and putting one
    mark in front.
    """
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    crossing = re.compile(f"[^{MARK}]{MARK}|\n")
    probe = " a  b　ﬁ\n\tÅ Å "
    plain = MARK + probe.replace(" ", MARK)
    return not any(crossing.search(p) for p in pieces) and processor.normalize(probe) == plain


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class TextCounter:
    """Counts the tokens of texts with the table, a cache and the library."""

    def __init__(self, model: bytes, table: dict[str, int]):
        self.processor = load(model)
        self.table = table
        self.known = dict(table)
        self.whole = not splits_exactly(self.processor)
        # put before a pre-token without a mark: a line break never merges with it
        self.lead = len(self.processor.encode("\n"))

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        """Token counts of pre-tokens; the library puts one mark in front by itself."""
        plain = [p[1:] if p[0] == MARK else "\n" + p for p in pieces]
        for piece, ids in zip(pieces, self.processor.encode(plain, num_threads=1)):
            if piece[0] != MARK:
                yield piece, len(ids) - self.lead
            else:  # a mark alone: for an empty text the library puts none
                yield piece, len(ids) if len(piece) > 1 else 1

    def count(self, texts: list[str]) -> list[int]:
        if self.whole:
            return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]
        cut = [pre_tokens(t) for t in texts]
        known = self.known
        new = {p for pieces in cut for p in pieces if p not in known}
        if new:
            if len(known) > len(self.table) + CACHE:
                known = self.known = dict(self.table)
                new = {p for pieces in cut for p in pieces if p not in known}
            known.update(self._encoded(list(new)))
        counts = [sum(map(known.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONG:
                del known[p]
        return counts


def frequent_pre_tokens(docs: DataFrame, text: str, model: bytes, table_size: int = TABLE) -> dict[str, int]:
    """The most frequent pre-tokens of all rows with their token counts."""

    def summary(batches):
        counts: Counter[str] = Counter()
        for batch in parts(batches, "text", size=CHUNK):
            for t in batch.column(0).to_pylist():
                counts.update(pre_tokens(t))
            if len(counts) > 4 * SUMMARY:
                counts = Counter(dict(counts.most_common(SUMMARY)))
        kept = [(p, n) for p, n in counts.most_common(SUMMARY) if n > 1 and len(p) <= LONG]
        for at in range(0, len(kept), 10_000):
            yield pa.RecordBatch.from_pylist([{"piece": p, "n": n} for p, n in kept[at:at + 10_000]], SUMMARIES)

    SUMMARIES = pa.schema([("piece", pa.string()), ("n", pa.int64())])
    pieces = (
        docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        .mapInArrow(summary, "piece string, n bigint")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(table_size)
    )
    counter = TextCounter(model, {})
    return dict(counter._encoded([r["piece"] for r in pieces.toLocalIterator()]) if not counter.whole else ())


def count_tokens(
    docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, table_size: int = TABLE
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``model_path`` is a SentencePiece model file that the driver can read; its
    content travels to the workers.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    tiers = spark.sparkContext.broadcast((model, frequent_pre_tokens(docs, text, model, table_size)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches):
        counter = None
        for batch in parts(batches, "text", size=CHUNK):
            counter = counter or TextCounter(*tiers.value)
            texts = batch.column("text").to_pylist()
            numbers = counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                [len(t.encode()) for t in texts], pa.int64()), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
