"""Main text of HTML pages by differencing pages of nearly the same URL.

Pages of a host are ordered by the path of their URL; a page is paired with its nearest pages on
both sides. Their lines are aligned by a longest common subsequence: what two pages share is the
template of the host, and shared lines are deleted. A partner that shares the longest line and most of the
characters is a copy of the page, tells nothing about the template and is passed over.

Two checks by markup follow, as differencing alone is wrong where a page has no partner, where advertisements rotate
and where pages quote the same passage:

- Lines in elements that are no article (navigation, headers, footers, asides, forms, advertisements, notices, reader comments)
  go, whether a partner shows them or not.
- A page that marks its article (``article``, else ``main``) keeps those lines, and only those: lines of it that a partner shows
  are deleted like all others, and put back.

Order and pairing: URLs are dealt by ranges and numbered, so a host may hold any share of the pages. Only hashes of lines are
paired, in blocks of ``BLOCK`` neighbours with the borders repeated; the pages themselves are read a second time and each is joined with the numbers
of its shared lines. Pages without a URL or HTML have none, and are dealt by what else is in them.

Defined results: a missing or empty page has the empty text. A page without a URL (or with one without a host) has no
partner. Rows with the same URL and HTML are one page, and get the same text. Other columns are kept; those named text and n_chars are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.llm.html_lines import ARTICLE, ASIDE, MAIN, lines_of
from haulframe.llm.numtext import parts
from haulframe.llm.storage import stored
from haulframe.operators.numbering import in_order

NEIGHBOURS = 2  # on each side
BLOCK = 500  # pages that are aligned in one task; neighbours at the borders are repeated
_TABLE = 10_000  # cells of an alignment that is solved as a whole


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b`` (bit-parallel)."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    ones = (1 << len(b)) - 1
    v = ones
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & ones
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _table(a: list[int], b: list[int]) -> list[int]:
    rows = [[0] * (len(b) + 1)]
    for x in a:
        above, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        rows.append(row)
    i, j, found = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def common_places(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in a longest common subsequence with ``b``; memory grows with the lengths, not their product."""
    in_b, in_a = set(b), set(a)
    at = [i for i, x in enumerate(a) if x in in_b]
    b = [x for x in b if x in in_a]
    a = [a[i] for i in at]
    if a == b:
        return at

    def solve(low: int, high: int, b: list[int]) -> list[int]:
        if low == high or not b:
            return []
        if (high - low) * len(b) <= _TABLE or high - low == 1:
            return [low + i for i in _table(a[low:high], b)]
        mid = (low + high) // 2
        up = _prefix_lengths(a[low:mid], b)
        down = _prefix_lengths(a[mid:high][::-1], b[::-1])[::-1]
        cut = int(np.argmax(up + down))
        return solve(low, mid, b[:cut]) + solve(mid, high, b[cut:])

    return [at[i] for i in solve(0, len(a), b)]


def shared_lines(own: list[int], chars: list[int], partners: list[list[int]]) -> list[int]:
    """Numbers of the lines that a page shares with some partner that is no copy of it."""
    if not own:
        return []
    longest, total = max(range(len(own)), key=chars.__getitem__), sum(chars)
    out: set[int] = set()
    for other in partners:
        places = common_places(own, other) if other else []
        size = sum(chars[i] for i in places)
        if longest in places and 2 * size > total:
            continue  # a copy
        out.update(places)
    return sorted(out)


def kept_lines(lines: list[tuple[str, int]], shared: list[int]) -> tuple[list[int], list[int]]:
    """Numbers of the lines that are left, and of those among them that differencing had deleted and the check by markup put back."""
    gone = set(shared)
    left = [i for i in range(len(lines)) if i not in gone]
    marked = max((part for _, part in lines if part in (MAIN, ARTICLE)), default=None)
    if marked is None:
        return [i for i in left if lines[i][1] != ASIDE], []
    back = [i for i in sorted(gone) if lines[i][1] == marked]
    return sorted([i for i in left if lines[i][1] == marked] + back), back


def main_text(lines: list[tuple[str, int]], shared: list[int]) -> str:
    """Lines that are left, joined by blanks."""
    return " ".join(lines[i][0] for i in kept_lines(lines, shared)[0])


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _key(html: Column) -> Column:
    return F.unhex(F.md5(html.cast("binary")))


def shared_line_numbers(pages: DataFrame, url: str = "url", html: str = "html", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(_url, _key, shared): numbers of the lines that a page shares. Stored.

    Of all pages that share any; ``_key`` is the MD5 of the HTML.
    """
    rows = pages.where(F.col(html).isNotNull()).select(
        F.col(url).cast("string").alias("_url"), _key(F.col(html)).alias("_key"), F.col(html).cast("string").alias("_html"),
    ).withColumn("host", F.lower(F.regexp_extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    rows = rows.where(F.length("host") > 0).withColumn("path", F.regexp_extract("_url", r"^[^:]*://[^/?#]*([^?#]*)", 1))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_html"):
            found = [lines_of(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("_url", "_key", "host", "path")),
                pa.array([[_hash(t) for t, _ in f] for f in found], pa.list_(pa.int64())),
                pa.array([[len(t) for t, _ in f] for f in found], pa.list_(pa.int32())),
            ], ["_url", "_key", "host", "path", "lines", "chars"])

    facts = rows.mapInArrow(described, "_url string, _key binary, host string, path string, lines array<bigint>, chars array<int>")
    facts = facts.groupBy("host", "path", "_url", "_key").agg(*(F.any_value(c).alias(c) for c in ("lines", "chars")))
    placed = in_order(facts, ["host", "path", "_url", "_key"], "at").drop("path")
    # a page stands in its block, and in the next one too where it is a neighbour of pages there
    block = lambda shift: F.floor((F.col("at") + shift) / BLOCK)
    home = block(0)
    blocks = placed.withColumn("_home", home).withColumn(
        "block", F.explode(F.array_distinct(F.array(home, block(neighbours), block(-neighbours))))
    )
    order = Window.partitionBy("block").orderBy("at")

    def near(step: int) -> Column:
        of = lambda c: F.lag(c, step).over(order)
        return F.when(of("host") == F.col("host"), of("lines"))

    steps = [s for s in range(-neighbours, neighbours + 1) if s]
    paired = blocks.select("*", *(near(s).alias(f"near{s}") for s in steps)).where(F.col("block") == F.col("_home"))
    partners = F.filter(F.array(*(F.col(f"near{s}") for s in steps)), lambda x: x.isNotNull())

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, chars, others = (batch.column(c).to_pylist() for c in ("lines", "chars", "partners"))
            shared = [shared_lines(*x) for x in zip(own, chars, others)]
            some = pa.array([bool(s) for s in shared], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_url", "_key")), pa.array(shared, pa.list_(pa.int32()))], ["_url", "_key", "shared"]
            ).filter(some)

    found = paired.select("_url", "_key", "lines", "chars", partners.alias("partners")).mapInArrow(
        aligned, "_url string, _key binary, shared array<int>"
    )
    return stored(found, "shared-lines")


def extract(pages: DataFrame, url: str = "url", html: str = "html", neighbours: int = NEIGHBOURS, counts: bool = False) -> DataFrame:
    """``pages`` with text and n_chars (its characters) in place of the HTML.

    With ``counts`` also n_deleted, the lines that differencing deleted, and n_restored, those of them that the check by markup put back.
    """
    shared = shared_line_numbers(pages, url, html, neighbours)
    added = ["text", "n_chars"] + ["n_deleted", "n_restored"] * counts
    names = [c for c in pages.columns if c not in (html, *added)]
    others = F.struct(*(F.col(c) for c in names), F.lit(0).alias("_none"))  # whatever their names are, they clash with none here
    # a page without a URL or HTML matches nothing, as its key is shorter than an MD5
    simple = [c for c in names if isinstance(pages.schema[c].dataType, T.AtomicType)]
    dealt = F.unhex(F.hex(F.xxhash64(F.lit(0), *simple)))
    key = F.when(F.col(url).isNotNull() & F.col(html).isNotNull(), _key(F.col(html))).otherwise(dealt)
    kept = pages.select(F.col(html).cast("string").alias("_page"), key.alias("_page_key"), F.col(url).cast("string").alias("_page_url"), others.alias("_others"))
    # shared lines grow with the pages, so they are not broadcast; a hash join does not sort the HTML
    joined = kept.join(
        shared.hint("shuffle_hash"), (F.col("_page_url") == F.col("_url")) & (F.col("_page_key") == F.col("_key")), "left"
    ).select("_page", "shared", "_others")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_page"):
            texts, found = [], []
            for page, gone in zip(batch.column("_page").to_pylist(), batch.column("shared").to_pylist()):
                lines = lines_of(page) if page else []
                left, back = kept_lines(lines, gone or [])
                texts.append(" ".join(lines[i][0] for i in left))
                found.append((len(texts[-1]), len(gone or []), len(back)))
            numbers = [pa.array(n, pa.int64()) for n in zip(*found)][:len(added) - 1]
            yield pa.RecordBatch.from_arrays([*batch.column("_others").flatten()[:-1], pa.array(texts, pa.string()), *numbers], [*names, *added])

    schema = T.StructType([
        *(pages.schema[c] for c in names), T.StructField("text", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in added[1:]),
    ])
    return joined.mapInArrow(cut, schema)
