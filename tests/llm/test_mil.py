import zlib

import numpy as np

from haulframe.llm import mil
from haulframe.llm.queries import op3_quality, table

SF = "/root/testdata/sf0.01"


def test_gradient():
    rng = np.random.default_rng(0)
    x, counts, label = rng.normal(size=(9, 5)), np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    model = mil.Model.start(x, 4, 3)

    def loss():
        z = model.forward(x, counts)[0]
        return float((np.log1p(np.exp(z)) - label * z).sum())

    logit, kept = model.forward(x, counts)
    grad = model.gradient(kept, counts, 1 / (1 + np.exp(-logit)) - label)
    for name, w in model.weights.items():
        for at in np.ndindex(w.shape):
            old, step = w[at], 1e-6
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-5


def test_attention_weighs_passages():
    rng = np.random.default_rng(1)
    model = mil.Model.start(rng.normal(size=(8, 5)))
    share = model.forward(rng.normal(size=(8, 5)), np.array([3, 5]))[1][4]
    assert np.allclose(np.add.reduceat(share, [0, 3]), 1) and (share > 0).all()


def test_held_out_accuracy(spark):
    rows = op3_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    assert len(rows) > 50 and np.mean(right) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_and_metadata_do_not_matter(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    changed = labels.withColumn("quality", mil.F.when(mil.held_out(), 1 - mil.F.col("quality")).otherwise(mil.F.col("quality")))
    moved = docs.withColumn("lang", mil.F.lit("xx")).withColumn("source", mil.F.lit("yy"))
    one = {r["doc_id"]: r["score"] for r in mil.quality(docs, labels).collect()}
    two = {r["doc_id"]: r["score"] for r in mil.quality(moved, changed).collect()}
    assert one == two


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (9, None, 0), (7, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = mil.quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in mil.quality(odd_docs, no_labels).collect()} == {0.5}
    assert mil.quality(no_docs, labels).collect() == []
    kept = mil.accepted(odd_docs, labels)
    assert kept.schema == odd_docs.schema


def test_passages_cover_the_whole_text():
    texts = [b"", b"a " * 64, b"a " * 65, b"x" * 3_000_000, b"\n"]
    x, counts = mil.passages(texts)
    assert counts.tolist() == [1, 1, 2, 1, 1] and len(x) == 6 and np.isfinite(x).all()


def test_fitting_reads_whole_texts_within_its_bound(spark, monkeypatch):
    """What parts the labels lies in one late passage; the bound counts all passages and leaves out whole documents only."""
    noise = "%% && ## ** << >> || $$ " * 8
    texts = [" ".join(f"word{i}" for i in range(64 * 60)) + (" " + noise if k % 2 else " plain words stay plain") for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "int(1 - doc_id % 2) as quality")
    seen = []
    real = mil.fit
    monkeypatch.setattr(mil, "fit", lambda x, counts, label, **kw: seen.append((counts.copy(), label.copy())) or real(x, counts, label, **kw))
    model = mil.fit_quality(docs, labels)
    assert set(seen[0][0].tolist()) == {61}
    scored = mil.score_documents(docs, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in scored)
    mil.fit_quality(docs, labels, sample_passages=61 * 7 + 5)
    counts, label = seen[1]
    assert set(counts.tolist()) == {61} and [(label == k).sum() for k in (0, 1)] == [7, 7]
    assert mil.fit_quality(docs, labels, sample_passages=60) is None
