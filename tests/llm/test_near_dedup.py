import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulframe.llm import near_dedup as nd
from haulframe.llm.components import connected_components
from haulframe.llm.minhash import CHOICES, branch, leaves, signatures
from haulframe.llm.numtext import LOWER, Words

SCHEMA = "doc_id bigint, text string"



def test_repeated_and_missing_ids_leave_one_row(spark):
    words = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join(words[:k] + [f"x{k}"] + words[k + 1:])
    rows = [(1, near(10)), (1, near(20)), (1, near(30)), (None, near(40)), (None, near(50)), (2, "quite another text of some words"), (None, None), (None, "")]  # a missing text counts as an empty one
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in nd.one_of_each(d).collect()]
    assert len(kept) == 3 and sum((t or "").startswith("w0") for _, t in kept) == 1 and next(i for i, t in kept if (t or "").startswith("w0")) == 1
    unnamed = spark.createDataFrame([(None, near(40)), (None, near(50)), (None, near(50))], "doc_id bigint, text string")
    assert nd.one_of_each(unnamed).count() == 1


def shingle_set(text, words):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(docs, words, percent):
    sets = [shingle_set(t, words) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    out = []
    for i, (doc, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root[j] == root[i] and docs[j][0] is not None]
        name = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), name, doc == name))
    return sorted(out, key=repr)


def run(spark, docs, words=4, percent=80):
    df = spark.createDataFrame(docs, SCHEMA)
    return sorted(map(tuple, nd.near_duplicates(df, words=words, percent=percent).drop("key").collect()), key=repr)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(rng.randint(1, 7)):
            docs.append((len(docs), edited(rng, base, rng.choice([0, 0, 1, 2, 6]))))
    docs += [(len(docs), docs[0][1].upper()), (len(docs), None), (len(docs), " \n"), (len(docs), ""), (len(docs), "one two"), (len(docs), "One\ttwo")]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs, 4, 80)


def test_large_group_and_strangers(spark, monkeypatch):
    """Nodes that are dealt into many blocks, with members outside the largest component."""
    import haulframe.llm.links as links

    monkeypatch.setattr(links, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4]))) for i in range(120)]
    assert run(spark, docs) == brute(docs, 4, 80)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted(map(tuple, nd.near_duplicates(odd_docs, words=4).drop("key").collect()), key=repr)
    assert got == brute(docs, 4, 80)
    assert nd.near_duplicates(no_docs).collect() == []
    kept = nd.one_of_each(odd_docs, words=4)
    assert kept.schema == odd_docs.schema
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and {d for d, _ in rows} <= {d for d, _ in docs}
    assert nd.one_of_each(no_docs).collect() == []


def test_shorter_texts_are_one_shingle():
    sets = nd.shingle_sets([b"a b", b"A  b", b"a b c d", b"", b"a", b"b a b c d a b c d"], 4)
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 5]
    assert sets[0].tolist() == sets[1].tolist() != sets[4].tolist()


def test_word_hashes_follow_words():
    w = Words([b"ab c", b"", b"c\tab  ab"], LOWER)
    assert w.hash[0] == w.hash[3] == w.hash[4] != w.hash[1] and w.hash[1] == w.hash[2]
    assert w.doc.tolist() == [0, 0, 2, 2, 2]


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_trees(similarity):
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(150):
        shared, own = int(400 * similarity), int(400 * (1 - similarity) / 2)
        a, b = (rng.integers(0, 2**63, own, dtype=np.uint64) for _ in range(2))
        both = rng.integers(0, 2**63, shared, dtype=np.uint64)
        sig = signatures(np.concatenate((both, a, both, b)), np.array([0, shared + own]), nd.TREES * nd.DEPTH * CHOICES)
        row, node, _ = leaves(sig, nd.TREES, nd.DEPTH, 0.8)
        met += bool(set(node[row == 0]) & set(node[row == 1]))
    assert met >= 149


def test_pairs_outlast_further_levels():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(60):
        a, b = (rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(2))
        both = rng.integers(0, 2**63, 320, dtype=np.uint64)
        flat, first = np.concatenate((both, a, both, b)), np.array([0, 360])
        row, node, tree = leaves(signatures(flat, first, nd.TREES * nd.DEPTH * CHOICES), nd.TREES, nd.DEPTH, 0.8)
        for level in range(1, 9):
            row, node, tree = branch(signatures(flat, first, nd.TREES * CHOICES, draw=level), row, node, tree, nd.MORE)
            together = np.isin(node, np.intersect1d(node[row == 0], node[row == 1]))  # the others cannot meet any more
            row, node, tree = row[together], node[together], tree[together]
        met += bool(len(row))
    assert met >= 59


def _open_nodes(spark, sets, depth):
    n = np.array([len(x) for x in sets])
    sig = signatures(np.concatenate(sets), np.cumsum(n) - n, nd.TREES * depth * CHOICES)
    table = [(i, bytearray(x.tobytes()), bytearray(s.tobytes())) for i, (x, s) in enumerate(zip(sig, sets))]
    items = spark.createDataFrame(table, "rid bigint, sig binary, elements binary")
    members = nd._leaves(items, nd.TREES, depth, 0.8).withColumn("component", F.col("rid"))
    return items.select("rid", "elements"), members.join(members.groupBy("node").count().where("count > 1").select("node"), "node")


def _children(members, elements, level):
    return nd._children(members, elements, level, nd.TREES)


def test_large_nodes_branch_until_small(spark, monkeypatch):
    """Rows of one template at a similarity of 0.43 part; their near copies stay together."""
    import haulframe.llm.links as links

    monkeypatch.setattr(links, "BLOCK", 8)
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    base = draw(240)
    varied = [np.unique(np.concatenate((base, draw(160)))) for _ in range(150)]
    copies = [np.unique(np.append(x[4:], draw(4))) for x in varied[:30]]
    elements, rows = _open_nodes(spark, varied + copies, 1)
    by = {}
    for r in (out := links.branched(rows, elements, _children).collect()):
        by.setdefault(r["node"], set()).add(r["rid"])
    assert all(r["n"] == len(by[r["node"]]) for r in out)
    before = rows.groupBy("node").count().agg(F.sum(F.col("count") ** 2)).first()[0]
    assert sum(len(m) ** 2 for m in by.values()) * 5 < before
    assert all(any({i, 150 + i} <= m for m in by.values()) for i in range(30))


def test_nodes_that_no_branching_parts_stay(spark, monkeypatch):
    import haulframe.llm.links as links

    monkeypatch.setattr(links, "BLOCK", 8)
    elements, rows = _open_nodes(spark, [np.arange(1, 300, dtype=np.uint64) * np.uint64(2**40 + 9)] * 20, 1)
    got = links.branched(rows, elements, _children).groupBy("node").count().collect()
    assert got and {r["count"] for r in got} == {20}
    one = rows.withColumn("component", F.lit(1).cast("bigint"))
    assert links.branched(one, elements, _children).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
        if not changed:
            break
    assert got == root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_no_task_holds_more_than_two_blocks(spark, monkeypatch):
    """A node of strangers and one with a large component: every pair of different components meets once."""
    import haulframe.llm.links as links

    monkeypatch.setattr(links, "BLOCK", 64)
    rows = [(1, i, i, 600) for i in range(600)] + [(2, i, 0 if i < 500 else i, 540) for i in range(540)] + [(3, i, i, 9) for i in range(9)]
    by = {}
    for r in links.dealt(spark.createDataFrame(rows, "node bigint, rid bigint, component bigint, n bigint")).collect():
        by.setdefault((r["node"], r["first"], r["second"]), []).append((r["rid"], r["component"], r["side"]))
    met = {}
    for (node, *_), members in by.items():
        assert max(sum(m[2] == side for m in members) for side in (0, 1, 2)) <= 64
        for a, c, x in members:
            for b, d, y in members:
                if a < b and c != d and x + y in (0, 3):
                    met[node, a, b] = met.get((node, a, b), 0) + 1
    want = {(1, a, b) for b in range(600) for a in range(b)} | {(3, a, b) for b in range(9) for a in range(b)}
    want |= {(2, a, b) for b in range(500, 540) for a in range(b)}
    assert set(met) == want and set(met.values()) == {1}


@pytest.mark.parametrize("width", [16, 4096])
def test_block_links_equal_brute_force(monkeypatch, width):
    import haulframe.llm.links as links

    monkeypatch.setattr(links, "WIDTH", width)
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        base = [rng.choice(300, 40, replace=False) for _ in range(3)]
        sets = [np.unique(np.append(rng.permutation(base[rng.integers(3)])[rng.integers(8):], rng.integers(0, 300, rng.integers(8)))).astype(np.uint64) for _ in range(n)]
        component = rng.integers(0, n, n) if n % 2 else np.arange(n)
        side = rng.integers(1, 3, n) if n % 3 else np.zeros(n, dtype=np.int64)
        links_found = list(zip(*(x.tolist() for x in links.block_links(component, side, sets, 80))))
        alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
        pairs = [(i, j) for j in range(n) for i in range(n) if i != j and (side[i] + side[j] == 3 or not side.any()) and component[i] != component[j] and alike(i, j)]
        assert {tuple(sorted(x)) for x in links_found} <= {tuple(sorted(x)) for x in pairs}

        def classes(edges):
            root = component.tolist()
            for i, j in edges:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
            return {frozenset(i for i in range(n) if root[i] == r) for r in root}

        assert classes(links_found) == classes(pairs) and len(links_found) < n
