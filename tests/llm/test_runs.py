"""Periodic runs against a search over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulframe.llm import runs
from haulframe.llm.queries import op12_runs, table

SF = "/root/testdata/sf0.001"


def all_periods(codes, min_length=24, exponent=3):
    """Stretches of equal words q apart, for every q; the smallest q of a stretch is its period."""
    codes, found = np.asarray(codes), {}
    for q in range(1, len(codes) // exponent + 1):
        same = np.concatenate(([False], codes[q:] == codes[:-q], [False])).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if e - s + q >= max(min_length, exponent * q):
                found.setdefault((int(s), int(e - s + q)), q)
    return sorted((s, n, q) for (s, n), q in found.items())


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=8)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([(24, 3), (6, 3), (12, 4), (3, 3), (30, 5)]))
def test_runs_are_those_of_all_periods(some, limits):
    codes = np.array([c for piece, times in some for c in piece * times], dtype=np.int64)
    assert runs.runs_of(codes, *limits) == all_periods(codes, *limits)


def test_long_regular_texts():
    assert runs.runs_of(np.zeros(30_000, dtype=np.int64)) == [(0, 30_000, 1)]
    assert runs.runs_of(np.concatenate([np.arange(5000)] * 3)) == [(0, 15_000, 5000)]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert runs.runs_of(np.array(b)) == all_periods(b)


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    known = {}
    found = all_periods([known.setdefault(w, len(known)) for w in words])
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_on_whole_table(spark):
    rows = {r["doc_id"]: tuple(r) for r in op12_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert rows == {d: expected_row(d, t) for d, t in docs}
    assert sum(r[1] > 0 for r in rows.values()) > 5


def test_odd_rows(spark, odd_docs, no_docs):
    found = runs.collapse_runs(odd_docs.withColumnRenamed("key", "runs"))
    assert set(found.columns) == {*odd_docs.columns, "runs", "collapsed"} - {"key"}
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        known = {}
        want = all_periods([known.setdefault(w, len(known)) for w in words])
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] is not None and (want or r["collapsed"] == " ".join(words))
    assert runs.collapse_runs(no_docs).collect() == []


def test_ties_take_the_first(spark):
    line = " ".join(f"w{i}" for i in range(8))
    d = spark.createDataFrame([(1, " ".join([line] * 3 + ["x"] + [line] * 3))], "doc_id int, text string")
    r = runs.collapse_runs(d).withColumn("best", runs.strongest()).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 24, 8), (25, 24, 8)] and tuple(r["best"]) == (0, 24, 8)
    assert r["collapsed"] == f"{line} x {line}"


def test_limits_are_checked(spark, odd_docs):
    with pytest.raises(ValueError):
        runs.collapse_runs(odd_docs, exponent=2)
