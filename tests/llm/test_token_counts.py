import random

import pytest

from haulframe.llm import token_counts as tc
from haulframe.llm.queries import table, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor():
    with open(MODEL, "rb") as f:
        return tc.load(f.read())


def test_pre_tokens_add_up(processor):
    rng = random.Random(2)
    alphabet = " \n\t\r▁abcAB<>s/é汉字😀　́\x00'.,  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<s> </s><unk>", "x" * 5000, " " * 999]
    with open(MODEL, "rb") as f:
        counter = tc.TextCounter(f.read(), {"▁a": 1})
    assert not counter.whole
    assert counter.count(texts) == [len(ids) for ids in processor.encode(texts)]


def test_whole_table_and_odd_rows(spark, odd_docs, no_docs, processor):
    for docs in (table(spark, "/root/testdata/sf0.001", "documents"), odd_docs):
        for size in (0, 50, tc.TABLE):
            got = sorted(map(tuple, tc.count_tokens(docs, MODEL, table_size=size).collect()), key=repr)
            texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
            n = [len(ids) for ids in processor.encode([t for _, t in texts])]
            assert got == sorted(((i, len(t.encode()), k, k > 4096) for (i, t), k in zip(texts, n)), key=repr)
    assert tc.count_tokens(no_docs, MODEL).collect() == []


def test_full_cache_starts_again(processor, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 3)
    with open(MODEL, "rb") as f:
        counter = tc.TextCounter(f.read(), {"▁the": 1})
    for t in ("the cat sat on the mat", "a b c d e f g", "the end of the cat", "z" * 300 + " z"):
        assert counter.count([t]) == [len(processor.encode(t))]
