import zlib

import numpy as np
import pytest

from haulframe.llm import packing
from haulframe.llm.queries import pack, table, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, tokenizer, size=2048):
    want = []
    for doc, text in docs:
        ids = ids_of(tokenizer, text)
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        bounds = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r["length"] for r in rows) // size)


def test_whole_table(spark, tokenizer):
    docs = table(spark, SF, "documents")
    used, least = check(pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    assert used <= least + 1


def test_odd_rows(spark, odd_docs, no_docs, tokenizer):
    extra = odd_docs.unionByName(odd_docs.limit(1).selectExpr("99L as doc_id", "'a<|endoftext|>b ़א ٠  ' as text", "lang", "source", "n_chars", "key", "score", "rid"))
    check(pack(extra).collect(), [(r["doc_id"], r["text"]) for r in extra.collect()], tokenizer)
    assert pack(no_docs).collect() == []


def test_sequences_hold_the_ids(spark, odd_docs, tokenizer):
    out = packing.pack_documents(odd_docs, tokenizer_path("byte_bpe_50k.json"), size=64, with_ids=True).cache()
    held = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(out).collect()}
    for r in out.collect():
        assert held[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])


@pytest.mark.parametrize("low,high", [(1, 2048), (700, 1300), (300, 700), (1, 20), (683, 1024)])
def test_search_only_improves(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 1500)
    bins = packing.Bins(lengths, 2048)
    before, squares = bins.used(), int((bins.fill**2).sum())
    bins.search()
    assert bins.least() <= bins.used() <= before and int((bins.fill**2).sum()) >= squares
    assert sorted(sum(bins.members, [])) == list(range(1500)) and bins.fill.max() <= 2048
    assert all(int(lengths[m].sum()) == f for m, f in zip(bins.members, bins.fill))


def test_search_empties_bins_that_best_fit_leaves():
    lengths = np.random.default_rng(3).integers(300, 700, 2000)
    bins = packing.Bins(lengths, 2048)
    before = bins.used()
    bins.search()
    assert bins.used() < before


def test_lower_bound_against_all_packings():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 11, 5)
        best = min(len(set(p)) for p in product(range(5), repeat=5) if all(
            sum(n for n, q in zip(lengths, p) if q == b) <= 10 for b in set(p)))
        bins = packing.Bins(lengths, 10)
        bins.search()
        assert bins.least() <= best <= bins.used()


def test_groups_share_no_sequence(spark):
    """Pieces longer than half a sequence: every one needs its own, in groups of more than their mean size too."""
    cut = spark.range(1000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1025 + id % 1023 as length")
    rows = packing.pack(cut, 2048, group=50).collect()
    assert len(rows) == 1000 == len({r["sequence_id"] for r in rows}) and {r["offset"] for r in rows} == {0}


def test_search_ends_only_without_a_step():
    """No pair of open bins has an exchange that increases the squared fill, unless the bound is met."""
    for low, high in [(500, 800), (340, 1100), (400, 900)]:
        lengths = np.random.default_rng(low).integers(low, high, 250)
        bins = packing.Bins(lengths, 2048)
        bins.search()
        if bins.used() == bins.least():
            continue
        sums = [[[sum(lengths[list(p)].tolist()) for p in of] for of in bins._parcels(b)] for b in range(len(bins.fill))]
        fill = bins.fill.tolist()
        for a, b in ((a, b) for a in range(len(fill)) for b in range(len(fill)) if a != b and fill[a] and fill[b]):
            one, two = sums[a], sums[b]
            for more in [g - t for g in one[0] for t in (0, *two[0], *two[1])] + [g - t for g in one[1] for t in (0, *two[0])]:
                assert not (0 < more <= 2048 - fill[b] and fill[b] - fill[a] + more > 0)
