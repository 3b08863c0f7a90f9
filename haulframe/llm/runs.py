"""Periodic runs of words, found as maximal pairs.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and of at least
``max(min_length, exponent * q)`` words that no neighbouring word extends.

Two places i < j of a text are a maximal pair when the words before them differ (or i is the first
word) and their common continuation ends after l words. A run with period q that begins at i
makes (i, i + q) such a pair with l = length - q, and every maximal pair with
``q <= l / (exponent - 1)`` and ``l + q >= min_length`` spans a stretch that cannot be extended: it is
a run, or the same run seen with a multiple of its period. So per stretch the smallest distance remains and nothing
is extended afterwards.

Pairs come from the LCP-interval tree of the suffix array, from the deepest interval upwards. An interval
of depth l holds the starts of all its suffixes in order, each with its left word, which is its class. When two children
are joined, the smaller one's starts look for partners of other classes in the larger one, within
l / (exponent - 1) words. Starts so near to each other are equally spaced, as l words repeat at that distance, and all but the
first of them have one class: on the left only the first in reach can be of another class,
on the right all or none are. So a start costs two searches, and each further step reports a pair.

Only suffixes whose first ``least`` words (16 for 24 words and exponent 3) occur again in the text can
be in such a pair; a text without any is done after one sort of hashes of its word sequences. Everything else is
exact: words are compared as bytes, never by hash.

Texts are worked on row by row, without a shuffle: copies, hot sources and lost executors need nothing special.
Defined results: a missing or empty text has no words and no runs, and collapses to the empty text. Rows keep all their columns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.numtext import CHUNK, mix, parts

MIN_LENGTH = 24
EXPONENT = 3

_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ.

    A rank is the place of its class in the suffix array, so a suffix that is alone in its class is
    never sorted again. Ends count as smaller than any word.
    """
    n = len(codes)
    _, which, count = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[which]
    levels, step = [rank], 1
    open_ = np.flatnonzero(count[which] > 1)
    while len(open_):
        after = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)], -1)
        order = np.lexsort((after, rank[open_]))
        at, own, after = open_[order], rank[open_][order], after[order]
        new_class = np.ones(len(at), dtype=bool)
        new_class[1:] = own[1:] != own[:-1]
        new = new_class.copy()
        new[1:] |= after[1:] != after[:-1]
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(new_class, place, 0))
        mine = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[at] = own + mine - first
        levels.append(rank)
        alone = new & np.concatenate((new[1:], [True]))
        open_ = at[~alone]
        step *= 2
    return levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common continuation of places a and b (which differ)."""
    n = len(levels[0])
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + out, b + out
        inside = (i < n) & (j < n)
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        out += same.astype(np.int64) << k
    return out


def _joined(one: list[int], two: list[int], depth: int, left: list[int], reach: int, least_gap: int, found: dict) -> list[int]:
    """Starts of two children of an interval, in order; what pairs they make goes to ``found``."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if least_gap <= reach:
        for x in small:
            k = bisect_left(large, x - reach)
            if k < len(large):
                y = large[k]
                if x - y >= least_gap and left[y] != left[x]:
                    _report(found, y, x - y, depth)
            k = bisect_right(large, x + least_gap - 1)
            if k < len(large) and large[k] - x <= reach and left[large[k]] != left[x]:
                while k < len(large) and large[k] - x <= reach:
                    _report(found, x, large[k] - x, depth)
                    k += 1
    if len(small) * 8 < len(large):
        for x in small:
            insort(large, x)
        return large
    return sorted(large + small)


def _report(found: dict, start: int, gap: int, depth: int) -> None:
    key = (start, gap + depth)
    if found.get(key, gap) >= gap:
        found[key] = gap


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start and period."""
    n = len(codes)
    least = -(-min_length * (exponent - 1) // exponent)
    if n < least + 1:
        return []
    levels = _ranks(codes)
    places = np.empty(n, dtype=np.int64)
    places[levels[-1]] = np.arange(n)
    depth = _common(levels, places[:-1], places[1:])
    depth[depth < least] = 0
    chosen = np.zeros(n, dtype=bool)
    chosen[1:] |= depth > 0
    chosen[:-1] |= depth > 0
    if not chosen.any():
        return []
    above = np.concatenate(([0], depth))[chosen].tolist()  # common words with the suffix before
    left = [-1, *codes[:-1].tolist()]
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, list[int]]] = []
    last: list[int] = []

    def join(a, b, d):
        return _joined(a, b, d, left, d // (exponent - 1), max(1, min_length - d), found)

    for x, d in zip(places[chosen].tolist(), above):
        child = last
        while stack and stack[-1][0] > d:
            deep, held = stack.pop()
            child = join(held, child, deep)
        if d == 0:
            stack.clear()
        elif stack and stack[-1][0] == d:
            stack[-1] = (d, join(stack[-1][1], child, d))
        else:
            stack.append((d, child))
        last = [x]
    while stack:
        deep, held = stack.pop()
        last = join(held, last, deep)
    return sorted((s, n_words, q) for (s, n_words), q in found.items())


def _may_repeat(words: list[list[bytes]], n: int) -> np.ndarray:
    """Whether some sequence of ``n`` words occurs twice in a text: never false for one that has."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=int(size.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(words)), size)
    step = 1
    while 2 * step <= n:  # of the largest power of two up to n
        if len(h) <= step:
            return np.zeros(len(words), dtype=bool)
        h = mix(h[:-step] * np.uint64(0x9E37_79B9_7F4A_7C15) + h[step:])
        step *= 2
    inside = np.flatnonzero(doc[:len(h)] == doc[step - 1:])
    key = mix(h[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(words), dtype=bool)
    out[doc[inside[order[1:][again]]]] = True
    return out


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with runs (start, length, period; by start and period) and collapsed (the words that are left, joined by blanks).

    Columns of these names are replaced.
    """
    if exponent < 3 or min_length < exponent:
        raise ValueError("runs need an exponent of 3 at least and no fewer words than that")
    least = -(-min_length * (exponent - 1) // exponent)
    rows = docs.drop("runs", "collapsed").withColumn("_words", F.col(text).cast("string").cast("binary"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_words", size=2 * CHUNK):
            words = [t.split() if t else [] for t in batch.column("_words").to_pylist()]  # bytes: blanks and \t to \r
            runs: list[list] = [[] for _ in words]
            for i in np.flatnonzero(_may_repeat(words, least)).tolist():
                known: dict[bytes, int] = {}
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words[i]), dtype=np.int64, count=len(words[i]))
                runs[i] = runs_of(codes, min_length, exponent)
            left = [b" ".join(_kept(w, r) if r else w).decode("utf-8", "replace") for w, r in zip(words, runs)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            rest = [c for c in batch.schema.names if c != "_words"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(listed, kind), pa.array(left, pa.string())], [*rest, "runs", "collapsed"]
            )

    schema = T.StructType([*rows.drop("_words").schema.fields, T.StructField("runs", T._parse_datatype_string(_RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(searched, schema)


def strongest(runs: str = "runs") -> F.Column:
    """The run of greatest length / period, the first of equals; missing where there is none."""
    stronger = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(
        F.col(runs), F.get(F.col(runs), F.lit(0)), lambda best, r: F.when(stronger(best, r), r).otherwise(best)
    )
