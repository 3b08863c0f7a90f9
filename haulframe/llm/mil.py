"""Document quality by attention over passages.

A text is cut into passages. Each passage is described by shares of characters and by
repetition, encoded by one layer, and weighted by gated attention; the weighted sum of
the encoded passages gives the score. Encoder, attention and score are learnt
together from labels of whole documents.

The model is fitted on a sample of labelled documents drawn by hash, whole texts each: at most ``sample`` documents
and ``sample_passages`` passages per label. Scores use every passage of every text,
and nothing but the text.

Defined results: a missing or empty text is one passage without words. Without
labelled rows of both kinds every score is 0.5. A document labelled both ways counts as
0. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.numtext import Words, chunks, mix, parts
from haulframe.llm.storage import stored

PASSAGE_WORDS = 64
PUNCTUATION = list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
N_FEATURES = len(PUNCTUATION) + 12

CLASS = np.full(256, -1, dtype=np.int64)
for _i, _b in enumerate(PUNCTUATION):
    CLASS[_b] = _i
_P = len(PUNCTUATION)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:256] = _P, _P + 1, _P + 2, _P + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (one at least)."""
    features, counts = [], []
    for _, some in chunks(texts):
        w = Words(some)
        words = w.per_doc(slice(None))
        n = np.maximum(1, -(-words // PASSAGE_WORDS))
        first_word = np.cumsum(words) - words
        first_passage = np.cumsum(n) - n
        total = int(n.sum())
        of_word = first_passage[w.doc] + (np.arange(len(w.doc)) - first_word[w.doc]) // PASSAGE_WORDS
        size = np.bincount(of_word, minlength=total)
        length = np.bincount(of_word, weights=w.end - w.start, minlength=total)
        # bytes of words by class
        byte_word = np.repeat(np.arange(len(w.start)), w.end - w.start)
        kind = CLASS[w.buf[w.inside]]
        known = kind >= 0
        table = np.bincount(of_word[byte_word[known]] * (_P + 4) + kind[known], minlength=total * (_P + 4)).reshape(total, _P + 4)
        out = np.zeros((total, N_FEATURES), dtype=np.float32)
        out[:, :_P + 4] = np.sqrt(table / np.maximum(length, 1)[:, None])
        per_word = np.maximum(size, 1)
        out[:, _P + 4] = np.log1p(size)
        out[:, _P + 5] = length / per_word / 10
        same = np.zeros(len(w.hash), dtype=bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
        out[:, _P + 6] = np.bincount(of_word, weights=same, minlength=total) / per_word
        pair = np.unique(mix(w.hash + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        out[:, _P + 7] = np.bincount(of_word[pair], minlength=total) / per_word  # distinct words
        out[:, _P + 8] = np.bincount(of_word, weights=w.repeated(5), minlength=total) / per_word
        ends = w.buf[w.end - 1] if len(w.end) else w.buf[:0]
        plain = (CLASS[ends] == _P + 1) | (CLASS[ends] == _P + 3) | np.isin(ends, list(b".,"))
        out[:, _P + 9] = np.bincount(of_word, weights=~plain, minlength=total) / per_word
        short = (w.end - w.start) <= 1
        out[:, _P + 10] = np.bincount(of_word, weights=short, minlength=total) / per_word
        # share of the whole text that this passage's words take, for texts of few words
        out[:, _P + 11] = np.log1p(np.repeat(words, n)) / 10
        features.append(out)
        counts.append(n)
    if not features:
        return np.zeros((0, N_FEATURES), dtype=np.float32), np.zeros(0, dtype=np.int64)
    return np.concatenate(features), np.concatenate(counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights: encoder (w, b), attention gates (v, u, a), score (c, d), and the features' scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def start(x: np.ndarray, encoded: int = 24, gates: int = 12, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return Model(x.mean(axis=0), x.std(axis=0) + 1e-2, {
            "w": draw(x.shape[1], encoded), "b": np.zeros(encoded), "v": draw(encoded, gates), "u": draw(encoded, gates),
            "a": draw(gates), "c": draw(encoded), "d": np.zeros(1),
        })

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logit of every document, and what the gradient needs."""
        p, first = self.weights, np.cumsum(counts) - counts
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(s @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        share = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(share[:, None] * h, first, axis=0)
        return z @ p["c"] + p["d"][0], (s, h, t, g, share, z, first)

    def gradient(self, kept: tuple, counts: np.ndarray, wrong: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient for the given derivative of the loss by each logit."""
        p = self.weights
        s, h, t, g, share, z, first = kept
        dz = wrong[:, None] * p["c"]
        dz_each = np.repeat(dz, counts, axis=0)
        dshare = (dz_each * h).sum(axis=1)
        de = share * (dshare - np.repeat(np.add.reduceat(share * dshare, first), counts))
        dt, dg = de[:, None] * p["a"] * g * (1 - t**2), de[:, None] * p["a"] * t * g * (1 - g)
        dh = share[:, None] * dz_each + dt @ p["v"].T + dg @ p["u"].T
        ds = dh * (1 - h**2)
        return {
            "w": s.T @ ds, "b": ds.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ wrong,
            "d": np.array([wrong.sum()]),
        }

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, counts)[0])


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the mean log loss of documents, a half of the weight to each label."""
    model = Model.start(x, seed=seed)
    rng = np.random.default_rng(seed)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    first = np.cumsum(counts) - counts
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(w) for k, w in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            n = counts[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            logit, kept = model.forward(x[rows], n)
            wrong = (_sigmoid(logit) - label[docs]) * weight[docs] / len(docs)
            step += 1
            for k, g in model.gradient(kept, n, wrong).items():
                g = g + decay * model.weights[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.weights[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                sample: int = 2000, sample_passages: int = 64_000) -> Model | None:
    """A model from labelled documents outside the held-out third.

    Per label, documents are taken in the order of a hash of their id: the first ``sample`` of them, as long as their
    passages, all of them, add up to ``sample_passages`` at most. A document that has more on its own is not in the
    sample. So features of at most ``2 * sample_passages`` passages reach the driver.
    """
    usable = labels.where(~held_out(doc_id)).where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_doc")).agg(
        F.min(label).alias("_label")).where(F.col("_doc").isNotNull())
    drawn = [usable.where(F.col("_label") == k).orderBy(F.xxhash64("_doc"), "_doc").limit(sample) for k in (0, 1)]
    # at most 2 * sample ids: a proven bound
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    texts = rows.join(chosen, F.col("_id") == F.col("_doc")).groupBy("_doc", "_label").agg(F.min("text").alias("text"))

    def described(batches):
        for batch in parts(batches, "text"):
            x, counts = passages(batch.column("text").to_pylist())
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([
                batch.column("_doc"), batch.column("_label").cast(pa.int32()), pa.array(counts, pa.int64()),
                pa.array([x[a:a + n].astype("<f4").tobytes() for a, n in zip(first, counts)], pa.binary()),
            ], ["doc", "label", "n", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    seen = texts.select("_doc", "_label", "text").mapInArrow(described, f"doc {kind}, label int, n bigint, x binary")
    seen = stored(seen.where(F.col("n") <= sample_passages), "described")
    # at most `sample` rows per label
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("doc"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    taken = seen.select("doc", "label", F.sum("n").over(so_far).alias("n_so_far")).where(F.col("n_so_far") <= sample_passages)
    seen = seen.join(F.broadcast(taken.select(F.col("doc").alias("_taken"))), F.col("doc") == F.col("_taken"), "left_semi").toPandas()
    seen = seen.sort_values("doc", ignore_index=True)
    label_of = seen["label"].to_numpy(dtype=np.float64)
    if len(set(label_of.tolist())) < 2:
        return None
    per_doc = [np.frombuffer(b, dtype="<f4").reshape(-1, N_FEATURES) for b in seen["x"]]
    return fit(np.concatenate(per_doc).astype(np.float64), np.array([len(p) for p in per_doc]), label_of)


def score_documents(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text (label 1 likelier where higher)."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    keep = docs.columns
    rows = docs.withColumn("_score_text", F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def scored(batches):
        for batch in parts(batches, "_score_text"):
            texts = batch.column("_score_text").to_pylist()
            out = [model.scores(*passages(some)) for _, some in chunks(texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, name]
            )

    return rows.mapInArrow(scored, f"{kinds}, `{name}` double")


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 2000) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, doc_id, text, sample=sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    return score_documents(rows, model, "_t").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` whose score is at least ``threshold``, all columns kept."""
    model = fit_quality(docs, labels, doc_id, text)
    return score_documents(docs, model, text, "_quality_score").where(F.col("_quality_score") >= threshold).drop("_quality_score")
