"""Components of items that are similar, from nodes in which similar items meet.

Two items are candidates when they meet in a node (a band or a leaf of a tree).
Candidates are confirmed on their full sets, but only until all that meet are known to be
connected, which is what components need:

1. In every node each member is compared with one of them. Equal numbers of pairs
   and members, however large the node is. A node whose members are now in one
   component has nothing left to find.
2. In the others, elements that no other remaining item has bound the similarity of
   a member from above. Members that can reach nobody in a node leave it. The rest is
   compared with the member that has the fewest such elements.
3. A node with more than a block of members outside its largest component branches: its members go on to its
   children by newly drawn numbers, and on from those, as long as that leaves fewer pairs to compare.
4. What then remains is compared exhaustively: every pair of a node that is of different
   components, on the full sets. A node that no branching parts is dealt into blocks, and every pair of blocks
   is compared on its own, so that no task holds more than two; its largest component has
   blocks of its own, which do not meet each other. Of the links found there, those
   that join components are returned, fewer than members.

No link between members of a node is lost but by branching, whose chance the trees together keep small (see
`near_dedup`), and none is needed inside a component. In the first two steps texts travel for pairs whose
signatures agree well enough; a pair that they pass over is compared in the fourth. There each member travels once for each
block that its own meets: the work grows with the members, but for nodes that no branching parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.components import connected_components
from haulframe.llm.minhash import agreement, jaccard_at_least, least_agreement
from haulframe.llm.numtext import CHUNK, parts
from haulframe.llm.storage import bounded, stored

#: Members of a block at most; a pair of blocks is compared in one task.
BLOCK = 1024
#: Levels, each with fresh numbers, in which a large node may fail to part before it is compared as it is.
TRIES = 3
#: Elements of a block that are compared at once.
WIDTH = 4096

def _meeting(members: DataFrame) -> DataFrame:
    """Members of nodes with two members at least: node, rid, pivot, n.

    The pivot is the smallest member in an order that differs from node to node.
    """
    turned = F.col("rid").bitwiseXOR(F.col("node"))
    nodes = members.groupBy("node").agg(F.min(turned).alias("low"), F.max(turned).alias("high"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.where(F.col("low") != F.col("high")).select("node", F.col("low").bitwiseXOR(F.col("node")).alias("pivot"), "n")
    return stored(members.join(bounded(stored(nodes, "nodes")), "node"), "meeting")


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Stored pairs with a column of both items. Few pairs travel to the table, not the table to them."""
    few = bounded(pairs)

    def side(name: str) -> DataFrame:
        return table.select(F.col("rid").alias(name), F.col(column).alias(f"{column}_{name}")).join(few, name)

    return side("a").join(side("b"), ["a", "b"])


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Stored pairs whose signatures agree at least so well, stored."""
    def kept(batches):
        for batch in parts(batches, "sig_a", "sig_b"):
            good = agreement(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist()) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    rows = _with_both(pairs, sigs, "sig").select("a", "b", "sig_a", "sig_b")
    return stored(rows.mapInArrow(kept, "a bigint, b bigint"), "pairs")


def _confirmed(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable, percent: int) -> DataFrame:
    """Stored pairs that are similar on their full sets, stored."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    found = stored(texts(stored(ids, "ids")), "texts")

    def kept(batches):
        for batch in parts(batches, "text_a", "text_b"):
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            distinct = list({*a, *b})
            of = dict(zip(distinct, sets(distinct)))
            good = [jaccard_at_least(of[x], of[y], percent) for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = _with_both(pairs, found, "text").select("a", "b", "text_a", "text_b")
    return stored(rows.mapInArrow(kept, "a bigint, b bigint"), "links")


def _reach(ids: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable) -> DataFrame:
    """(rid, size, own) of items: elements of their sets, and those that no other of them has."""
    def elements(batches):
        for batch in parts(batches, "text", size=CHUNK):
            found = sets(batch.column("text").to_pylist())
            n = np.array([len(s) for s in found], dtype=np.int64)
            token = np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("rid").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n)), pa.array(token)
            ], ["rid", "size", "token"])

    each = stored(texts(ids), "texts").select("rid", "text").mapInArrow(elements, "rid bigint, size bigint, token bigint")
    by_token = each.groupBy("token").agg(F.min("rid").alias("rid"), F.max("rid").alias("last"))
    own = by_token.where(F.col("rid") == F.col("last")).groupBy("rid").agg(F.count(F.lit(1)).alias("own"))
    sizes = each.groupBy("rid").agg(F.max("size").alias("size"))
    return stored(sizes.join(own, "rid", "left").fillna(0, "own"), "reach")


def _reachable(rows: DataFrame, percent: int) -> DataFrame:
    """Members (with size, own) of nodes that can be similar to some member of their node.

    A member shares ``size - own`` elements at most with anyone, and the other has no
    fewer elements than the smallest member.
    """
    least = stored(rows.groupBy("node").agg(F.min("size").alias("least")), "least")
    shared = F.col("size") - F.col("own")
    union = F.col("size") + F.greatest(F.col("least") - shared, F.lit(0))
    return rows.join(bounded(least), "node").where(shared * 100 >= union * percent).drop("least")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _forest(a: np.ndarray, b: np.ndarray, component: np.ndarray) -> list[int]:
    """Places of the links that join what neither the components nor earlier links do."""
    root: dict[int, int] = {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    chosen = []
    for at, (x, y) in enumerate(zip(component[a].tolist(), component[b].tolist())):
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            chosen.append(at)
    return chosen


def block_links(component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of members) that connect all members of different components that are similar.

    ``side`` is 0 for all members of a block that meets itself; of two blocks, members of
    1 are compared with those of 2. Every pair is decided on its full sets.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    member = np.repeat(np.arange(len(sets)), size)
    code = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)[1]
    while True:  # a member whose elements the others have too seldom is similar to none of them
        common = np.bincount(code, minlength=1)[code] > 1
        shared = np.bincount(member[common], minlength=len(sets))
        lost = (100 * shared < percent * size)[member]
        if not lost.any():
            break
        member, code = member[~lost], code[~lost]
    rows = np.unique(member)
    one, two = rows[side[rows] != 2], rows[side[rows] != 1]
    place = np.zeros(len(sets), dtype=np.int64)
    place[rows] = np.arange(len(rows))
    code = np.unique(code[common], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = place[member[common]][order], code[order]
    both = np.zeros((len(one), len(two)))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, WIDTH):  # bounds the memory of the comparison
        a, b = np.searchsorted(code, (low, low + WIDTH))
        has = np.zeros((len(rows), min(WIDTH, int(code[-1]) + 1 - low)), dtype=np.float32)
        has[row[a:b], code[a:b] - low] = 1
        both += has[place[one]] @ has[place[two]].T  # whole numbers of at most WIDTH
    union = size[one, None] + size[two] - both
    good = (both > 0) & (100 * both >= percent * union) & (component[one, None] != component[two])
    if not side.any():
        good = np.triu(good, 1)
    i, j = np.nonzero(good)
    a, b = one[i], two[j]
    chosen = _forest(a, b, component)
    return a[chosen], b[chosen]


def dealt(rows: DataFrame) -> DataFrame:
    """Members of nodes, dealt into blocks, once for each pair of blocks they are compared in.

    ``rows``: node, rid, component, n (members of the node), and any others, which are kept.
    Adds first and second (the pair of blocks) and side (0: the block alone, 1 and 2: a member of the
    first or second). The largest component of a large node has its own blocks, which
    do not meet each other.
    """
    main = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("_c")).groupBy("node").agg(
        F.max_by("component", F.struct("_c", "component")).alias("main"), F.max("_c").alias("_c")
    )
    blocks = lambda n: F.when(n <= BLOCK, 1).otherwise(F.ceil(2 * n / BLOCK)).cast("int")  # noqa: E731  half full, as hashes deal unevenly
    is_main = (F.col("n") > BLOCK) & (F.col("component") == F.col("main"))
    turn = F.xxhash64("rid", "node")
    others = blocks(F.when(F.col("n") > BLOCK, F.greatest(F.col("n") - F.col("_c"), F.lit(1))).otherwise(F.col("n")))
    mains = blocks(F.col("_c"))
    last = F.when(F.col("n") > BLOCK, F.col("_others") + F.col("_mains")).otherwise(1) - 1
    return (
        rows.join(bounded(stored(main, "main")), "node").withColumns({"_others": others, "_mains": mains, "_main": is_main})
        .withColumn("_home", F.when(F.col("_main"), F.col("_others") + F.pmod(turn, F.col("_mains"))).otherwise(F.pmod(turn, F.col("_others"))).cast("int"))
        .withColumn("_met", F.explode(F.sequence(F.lit(0), F.when(F.col("_main"), F.col("_others") - 1).otherwise(last))))
        .select(
            *rows.columns, F.least("_home", "_met").alias("first"), F.greatest("_home", "_met").alias("second"),
            F.when(F.col("_home") == F.col("_met"), 0).when(F.col("_home") < F.col("_met"), 1).otherwise(2).alias("side"),
        )
    )


def _weighed(rows: DataFrame) -> DataFrame:
    """Per node of members of several components: node, n, others (not of the largest), work (pairs to compare)."""
    each = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
    nodes = each.groupBy("node").agg(F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("others"))
    return nodes.where("others > 0").withColumn("work", F.col("others").cast("double") * F.col("n"))


def _elements(ids: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable) -> DataFrame:
    """(rid, elements) of stored ids, stored: their sets as bytes."""
    def described(batches):
        for batch in parts(batches, "text", size=CHUNK):
            found = [s.tobytes() for s in sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, pa.binary())], ["rid", "elements"])

    return stored(stored(texts(ids), "texts").select("rid", "text").mapInArrow(described, "rid bigint, elements binary"), "sets")


def branched(rows: DataFrame, elements: DataFrame, children: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """``rows`` (node, rid, component, tree), with the descendants of large nodes in place of these, and n (members).

    A node is large while more than ``BLOCK`` of its members are outside its largest component. It gives way to its
    children where they have fewer pairs to compare in all, and stays where it does not in ``TRIES`` levels. Nodes whose members
    are all of one component are left out. ``elements`` (rid, elements) has the sets of all members.
    """
    names = ["node", "rid", "component", "tree", "n"]

    def parted(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of small nodes, and those of large ones with work."""
        all_in = some.join(bounded(stored(_weighed(some), "nodes")), "node")
        return all_in.where(F.col("others") <= BLOCK).select(names), all_in.where(F.col("others") > BLOCK).select(*names, "work", F.lit(0).alias("tries"))

    done, large = parted(rows.drop("n"))
    large, level = stored(large, "large"), 0
    while not large.isEmpty():
        level += 1
        of_large = elements.join(bounded(stored(large.select("rid").distinct(), "ids")), "rid")
        below = stored(children(large, of_large, level), "below")
        weighed = stored(_weighed(below).select("node", F.col("work").alias("rest")), "weighed")
        parents = below.select(F.col("parent").alias("node"), F.col("node").alias("child")).distinct()
        left = parents.join(weighed.withColumnRenamed("node", "child"), "child").groupBy("node").agg(F.sum("rest").alias("left"))
        before = large.groupBy("node").agg(F.max("work").alias("work")).join(left, "node", "left")
        gives_way = stored(before.where(F.coalesce("left", F.lit(0.0)) < F.col("work")).select("node"), "gives-way")
        stay = large.join(bounded(gives_way), "node", "left_anti").withColumn("tries", F.col("tries") + 1)
        parents = gives_way.withColumnRenamed("node", "parent")
        small, large = parted(below.join(bounded(parents), "parent", "left_semi").drop("parent"))
        done = done.unionByName(small).unionByName(stay.where(F.col("tries") >= TRIES).select(names))
        large = stored(large.unionByName(stay.where(F.col("tries") < TRIES)), "large")
    return stored(done, "branched")


def _links_inside(rows: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """Links that connect all similar members of a node that are of different components.

    ``rows``: node, rid, component, n (members of the node); ``elements`` (rid, elements) has their sets.
    """
    key = ["node", "first", "second"]

    def formed(batches):
        held = None  # rows of the last pair of blocks, which may go on
        for batch in (b for whole in batches for b in parts([whole], "elements")):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            column = [held.column(c).to_numpy() for c in key]
            edges = np.flatnonzero(np.any([np.diff(c) != 0 for c in column], axis=0)) + 1
            for a, b in zip([0, *edges], edges):
                yield linked(held.slice(a, b - a))
            if len(edges):
                held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield linked(held)

    def linked(table):
        rid, component, side = (table.column(c).to_numpy() for c in ("rid", "component", "side"))
        found = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("elements")]
        i, j = block_links(component, side, found, percent)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[i], rid[j])), pa.array(np.maximum(rid[i], rid[j]))], ["a", "b"])

    joined = dealt(rows.select("node", "rid", "component", "n")).join(elements, "rid")
    return joined.repartition(*key).sortWithinPartitions(*key).select(
        *key, "rid", "component", "side", "elements"
    ).mapInArrow(formed, "a bigint, b bigint").distinct()


def similar_components(
    members: DataFrame, sigs: DataFrame, texts: Callable[[DataFrame], DataFrame],
    sets: Callable[[list[bytes]], list[np.ndarray]], percent: int, k: int, children: Callable[[DataFrame, DataFrame, int], DataFrame],
) -> DataFrame:
    """(id, component) of all items that have a confirmed link.

    ``members`` (node, rid, tree) says who meets, ``sigs`` (rid, sig) has the signatures of
    ``k`` numbers, ``texts`` gives (rid, text as bytes) for a stored table of ids,
    ``sets`` the sorted sets of a list of texts, and ``children`` the next level below
    members (node, rid, component, tree), given their sets (rid, elements) and the number of the level, from 1.
    """
    def components(links: DataFrame) -> DataFrame:
        return stored(connected_components(links), "components").select(F.col("id").alias("rid"), "component")

    def still_open(rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows of nodes with members of different components."""
        plain = rows.drop("component", "n")
        classed = plain.join(bounded(known), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        mixed = classed.groupBy("node").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
        )
        mixed = stored(mixed.where(F.col("low") != F.col("high")).select("node", "n"), "mixed")
        return stored(classed.join(bounded(mixed), "node"), "open")

    def compared(pairs: DataFrame) -> DataFrame:
        return _alike(stored(pairs, "pairs"), sigs, least)

    least = least_agreement(percent / 100, k)
    meeting = _meeting(members)
    tried = compared(_pairs(meeting.where(F.col("rid") != F.col("pivot")), "rid", "pivot"))
    links = _confirmed(tried, texts, sets, percent)
    known = components(links)
    rows = still_open(meeting.select("node", "rid", "tree"), known)
    if rows.isEmpty():
        return known.select(F.col("rid").alias("id"), "component")

    reach = _reach(stored(rows.select("rid").distinct(), "ids"), texts, sets)
    rows = still_open(_reachable(rows.join(bounded(reach), "rid"), percent), known)
    fewest = rows.groupBy("node").agg(F.min_by("rid", F.struct("own", "rid")).alias("pivot"))
    star = rows.join(bounded(stored(fewest, "pivots")), "node").where(F.col("rid") != F.col("pivot"))
    star = compared(_pairs(star, "rid", "pivot").join(bounded(tried), ["a", "b"], "left_anti"))
    if not star.isEmpty():
        links = links.unionByName(_confirmed(star, texts, sets, percent))
        known = components(links)
        rows = still_open(rows, known)

    if rows.isEmpty():
        return known.select(F.col("rid").alias("id"), "component")
    elements = _elements(stored(rows.select("rid").distinct(), "ids"), texts, sets)
    rest = stored(_links_inside(branched(rows, elements, children), elements, percent), "links")
    if not rest.isEmpty():
        known = components(links.unionByName(rest))
    return known.select(F.col("rid").alias("id"), "component")


def links_of_nodes(
    members: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable[[list[bytes]], list[np.ndarray]], percent: int
) -> DataFrame:
    """Links (a, b) that connect all similar members of every node, for small sets.

    Every member is compared with one of its node. Those that are similar to that one are a class, all others their own;
    where there is more than one class, members of different classes are compared exhaustively.
    """
    meeting = _meeting(members)
    star = meeting.where(F.col("rid") != F.col("pivot"))
    links = _confirmed(stored(_pairs(star, "rid", "pivot"), "pairs"), texts, sets, percent)
    with_pivot = links.select("a", "b", F.lit(True).alias("linked"))
    classed = meeting.withColumns({"a": F.least("rid", "pivot"), "b": F.greatest("rid", "pivot")}).join(bounded(with_pivot), ["a", "b"], "left")
    classed = classed.withColumn("component", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("rid")))
    mixed = classed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = stored(mixed.where(F.col("low") != F.col("high")).select("node"), "mixed")
    if mixed.isEmpty():
        return links
    rows = stored(classed.join(bounded(mixed), "node").select("node", "rid", "component", "n"), "open")
    elements = _elements(stored(rows.select("rid").distinct(), "ids"), texts, sets)
    return links.unionByName(stored(_links_inside(rows, elements, percent), "links"))
