"""Ranked search against a plain scoring of every pair."""

import math
import re
from collections import Counter

import pytest

from haulframe.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    cut = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for *_, n in cut), sum(n for *_, n in cut)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for d, tf, n in cut:
            score = 0
            for t in set(terms(text)):
                if tf[t]:
                    df = sum(1 for _, other, _ in cut if other[t])
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 10 + 90 * n * n_docs // length
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, place, d, -s) for place, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the Quick fox 42"), (1, "the Quick fox 42"), (1, "word3 word4"), (2, None), (3, ""), (4, "nowhere-at-all"), (None, "dog ÉTÉ é漢字"), (5, "the over lazy dog dog dog")]


def found(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS score", "1 AS block")
    return sorted(map(tuple, search.search(docs, table, **more).collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"k": 2}, {"owners": 1}, {"owners": 3, "growth": 2}, {"max_terms": 3}])
def test_scores_of_odd_rows(spark, odd_docs, more):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(spark, odd_docs, ITEMS, **more) == plain(docs, ITEMS, more.get("k", 10))


def test_many_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 1)  # 64 documents a block
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(words[(i * j) % 12] for j in range(1, 2 + i % 9))) for i in range(600)]
    docs += [(i, "w1 w2 w3") for i in range(1000, 1200)]  # copies: equal scores over many blocks
    items = [(i, f"w{i} w{i + 1} w1") for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert found(spark, table, items) == plain(docs, items, 10)


def test_nothing_to_search(spark, odd_docs, no_docs):
    assert found(spark, no_docs, ITEMS) == []
    assert found(spark, odd_docs, []) == [] and found(spark, odd_docs, [(1, None), (2, " -- ")]) == []
    empty = search.search(no_docs, spark.createDataFrame([], "item_id string, text string"))
    assert empty.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_later_owners_hold_the_common_terms():
    import numpy as np

    df, uses = np.array([1, 1000, 5, 80, 1, 3]), np.array([1, 9, 1, 2, 3, 0])
    owner = search.owners_of(df, uses, 3, 10)
    assert owner[1] == 2 and owner[5] == 0 and all(owner[i] <= owner[1] for i in range(6))
    work = df * uses
    assert work[owner == 0].sum() * 10 <= work.sum() / 10 * 10 and work[owner <= 1].sum() <= work.sum() / 10 + work[owner == 1].max(initial=0)
