import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from haulframe.llm import decontaminate as dc

WORD = re.compile(dc.WORD)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        wins += [(item, w[i:i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(map(tuple, dc.contamination(d, b).drop("items").collect()), key=repr)


LETTERS = st.lists(st.sampled_from(["a", "B", "c-", "é", "D3", "\x7f", "..."]), max_size=40).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LETTERS, min_size=1, max_size=6), st.lists(LETTERS, min_size=1, max_size=4))
def test_equals_brute_force(spark, texts, item_texts):
    docs = [(i // 2, t) for i, t in enumerate(texts)]
    items = [(i // 2, t) for i, t in enumerate(item_texts)]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "quick brown fox"), (None, "lazy dog"), (2, None), (3, "..."), (2, "the quick brown fox jumps over the lazy dog and then it sleeps all day"), (9, "ONE TWO")]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, dc.contamination(odd_docs, b).drop("items").collect()), key=repr) == brute(docs, items)
    assert dc.contamination(no_docs, b).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in dc.contamination(odd_docs, none).collect())
    clean = dc.clean_documents(odd_docs, b)
    assert clean.schema == odd_docs.schema
    dirty = {r[0] for r in brute([(t, t) for _, t in docs], items) if r[-1]}
    assert sorted(map(repr, (r["text"] for r in clean.collect()))) == sorted(repr(t) for _, t in docs if t not in dirty)


def test_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    docs = [(i, f"a b c d e f {i} h i j k l m n o p") for i in range(30)]
    items = [(i, f"c d e f {i} h i j k l m n o") for i in range(0, 30, 3)]
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 2)
    assert run(spark, docs, items) == brute(docs, items)
