import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from haulframe.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    axes = [f"a{i}" for i in range(n)]
    cells = spark.createDataFrame(list(itertools.product(range(2**bits), repeat=n)), axes)
    rows = sharding.with_hilbert_index(cells, axes, bits, "h").orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, odd_docs, no_docs):
    rows = sharding.hilbert_shards(odd_docs, shards=4).collect()
    docs = odd_docs.collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
        (repr(d["doc_id"]), len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    by = [[r["slot"] for r in rows if r["shard"] == s] for s in range(4)]
    assert max(map(len, by)) - min(map(len, by)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by)
    assert sharding.hilbert_shards(no_docs).collect() == []


def test_shards_are_small_boxes(spark):
    docs = spark.range(4096).selectExpr(
        "id as doc_id", "'x' as text", "concat('l', id % 8) as lang", "concat('s', id div 8 % 16) as source", "id % 61 as n_chars")
    rows = sharding.hilbert_shards(docs, shards=16).join(docs, "doc_id").groupBy("shard").agg(
        {"lang": "min", "source": "min"}).collect()
    assert len(rows) == 16
    pairs = sharding.hilbert_shards(docs, shards=16).join(docs, "doc_id").select("shard", "lang", "source").distinct().count()
    assert pairs < 16 * 8 * 16 / 2  # a reader of one (lang, source) opens a few shards only


def test_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = sharding.hilbert_shards(docs).collect()
    assert len(rows) == 2 and len({r["shard"] for r in rows}) == 2 and {r["slot"] for r in rows} == {0}


@pytest.mark.parametrize("names", ["src{:02d}", "common_crawl_{:02d}", "https://example.org/{:02d}"])
def test_sources_that_begin_alike_stay_apart(spark, names):
    sources = [names.format(i) for i in range(16)]
    docs = spark.createDataFrame([(i, "x", "en", sources[i % 16], 5) for i in range(1600)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = sharding.hilbert_shards(docs, shards=16).join(docs, "doc_id").groupBy("shard").agg(F.count_distinct("source").alias("n")).collect()
    assert [r["n"] for r in rows] == [1] * 16


@pytest.mark.parametrize("hot", [1, 5000])
def test_many_values_share_classes_in_their_order(spark, hot, monkeypatch):
    """Several blocks of values, one of them with most rows."""
    monkeypatch.setattr(sharding, "_BLOCK", 4)
    values = [f"common prefix {i:03d}" for i in range(100)]
    rows = [(v,) for i, v in enumerate(values) for _ in range(hot if i == 40 else 3)] + [(None,)] * 4
    got = {r["_value"]: r["_class"] for r in sharding.text_classes(spark.createDataFrame(rows, "v string"), "v", 31).collect()}
    n, before = len(rows) - 4, 0
    for i, v in enumerate(values):
        assert got[v] == 1 + before * 31 // n
        before += hot if i == 40 else 3
    assert len(got) == 100
