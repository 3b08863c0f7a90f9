"""Documents packed into sequences of a fixed number of tokens.

A document is its token ids and a closing id. Only documents longer than a sequence
are cut, into full pieces behind a first one that takes the rest, so a full piece is
a sequence by itself. The other pieces are dealt at random into packing groups of a
fixed mean size, whatever the input size, and each group is packed on its own: best fit,
longest first, then a local search between underfull sequences. It moves a piece, swaps
one for one, one for two or two for one, whenever the sum of squared fills grows, until
no open sequence has such a step any more or the sum of lengths shows that none could be emptied.

Groups cost at most one sequence each over the optimum of the whole, when each
group reaches its own bound.

Defined results: a missing or empty text is the closing id alone. Repeated rows are
documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulframe.llm.numtext import parts
from haulframe.llm.storage import stored

GROUP = 8192
#: Long-settled blocks, in which every Unicode version classes letters, digits and spaces alike.
UNSETTLED = re.compile("[^\u0000-ԯ -⁯ぁ-ゖァ-ヺ一-龥가-힣]")

_encoders: dict[bytes, object] = {}


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit numbers.

    The same vocabulary given as ranks encodes several times faster. It is used where both
    must agree; a text with characters that Unicode versions may class differently goes
    through the tokenizer file itself.
    """

    def __init__(self, tokenizer: bytes, ranks: bytes | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = None
        if ranks is not None:
            import tiktoken

            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or UNSETTLED.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def _encoder(files: tuple) -> Encoder:
    if files[0] not in _encoders:
        _encoders[files[0]] = Encoder(*files)
    return _encoders[files[0]]


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
    doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and ``ids``, packed bytes).

    ``tokenizer_path`` is a file of the tokenizers library; ``ranks_path`` and ``pattern`` may
    give the same vocabulary as ranks. The driver reads the files and sends their content.
    """
    def content(path):
        if path is None:
            return None
        with open(path, "rb") as f:
            return f.read()

    files = docs.sparkSession.sparkContext.broadcast((content(tokenizer_path), content(ranks_path), pattern))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")
    closing = end.tobytes()

    def cut(batches):
        encoder = _encoder(files.value)
        for batch in parts(batches, "text"):
            owner, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
            packed: list[bytes] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                ids = encoder.ids(t).tobytes() + closing
                n = len(ids) // 4
                first = n if n <= size else n % size
                bounds = [b for b in (0, first, *range(first + size, n + 1, size))]
                bounds = sorted(set(bounds))
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[4 * a:4 * b]
                    owner.append(i)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        packed.append(part)
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]
            names = ["doc_id", *out]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, f"doc_id {kind}, {PIECES}" + ", ids binary" * with_ids)


class Bins:
    """Bins of a fixed size under best fit and local search."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.members: list[list[int]] = []
        self.where = np.zeros(len(lengths), dtype=np.int64)
        self.fill = np.zeros(0, dtype=np.int64)
        self.best_fit()

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that has room."""
        gaps: list[tuple[int, int]] = []  # sorted (room, bin)
        fill: list[int] = []
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[item])
            at = bisect.bisect_left(gaps, (n, -1))
            if at < len(gaps):
                room, b = gaps.pop(at)
                self.members[b].append(item)
                fill[b] += n
            else:
                b, room = len(self.members), self.size
                self.members.append([item])
                fill.append(n)
            self.where[item] = b
            if room > n:
                bisect.insort(gaps, (room - n, b))
        self.fill = np.array(fill, dtype=np.int64)

    def least(self) -> int:
        """A number of bins that no packing can go below.

        For each length up to half a bin: items that leave no room for it need a bin
        each, as do other items over half; what the latter cannot take up of the
        rest needs more.
        """
        n, size = np.sort(self.lengths), self.size
        total = np.concatenate(([0], np.cumsum(n)))
        low = np.unique(np.concatenate(([0], n[n <= size // 2])))
        at_low = np.searchsorted(n, low, "left")
        at_half = np.searchsorted(n, size // 2, "right")
        at_high = np.searchsorted(n, size - low, "right")
        alone, over = len(n) - at_high, at_high - at_half
        spare = over * size - (total[at_high] - total[at_half])
        rest = np.maximum(0, total[at_half] - total[at_low] - spare)
        return int((alone + over + -(-rest // size)).max())

    def used(self) -> int:
        return int((self.fill > 0).sum())

    def _parcels(self, b: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
        """Single items and pairs of a bin, one for each length and sum: few, as lengths add up to a bin."""
        ones = {int(self.lengths[i]): (i,) for i in self.members[b]}
        twos = {}
        by_length: dict[int, list[int]] = {}
        for i in self.members[b]:
            by_length.setdefault(int(self.lengths[i]), []).append(i)
        lengths = list(by_length)
        for at, n in enumerate(lengths):
            if len(by_length[n]) > 1:
                twos[2 * n] = tuple(by_length[n][:2])
            for other in lengths[at + 1:]:
                twos[n + other] = (by_length[n][0], by_length[other][0])
        return list(ones.values()), list(twos.values())

    def _pairs(self, bins) -> np.ndarray:
        found = [p for b in bins for p in self._parcels(b)[1]]
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def search(self) -> None:
        """Exchanges between two bins, the poorest bins first, until no open bin has one.

        Every step increases the sum of squared fills, which is a bounded whole
        number, so the search ends. A bin without a step is looked at again only with
        bins that have changed since.
        """
        least = self.least()
        used = self.used()
        changed = np.zeros(len(self.fill), dtype=np.int64)  # the step that last changed a bin
        looked = np.full(len(self.fill), -1, dtype=np.int64)  # the step after which it was found to have none
        pairs, steps = None, 0
        while used > least:
            is_open = (self.fill > 0) & (self.fill < self.size)
            if pairs is None:
                pairs = self._pairs(np.flatnonzero(is_open).tolist())
            # a pair holds as long as its items share a bin
            pairs = pairs[self.where[pairs[:, 0]] == self.where[pairs[:, 1]]]
            waiting = np.flatnonzero(is_open & (looked < steps))
            waiting = waiting[np.argsort(self.fill[waiting], kind="stable")]
            rest = waiting[16:]  # after the poorest, those not looked at for longest
            for b in [*waiting[:16].tolist(), *rest[np.argsort(looked[rest], kind="stable")].tolist()]:
                since = looked[b] if changed[b] <= looked[b] else -1
                step = self._best_step(b, pairs, changed > since)
                if step is not None:
                    break
                looked[b] = steps
            else:
                return
            poor, rich = step[:2]
            self._exchange(*step)
            steps += 1
            changed[[poor, rich]] = steps
            used -= int(self.fill[poor] == 0)
            pairs = np.concatenate((pairs, self._pairs([poor, rich])))

    def _exchange(self, poor: int, rich: int, give: tuple[int, ...], take: tuple[int, ...]) -> None:
        for source, target, items in ((poor, rich, give), (rich, poor, take)):
            for i in items:
                self.members[source].remove(i)
                self.members[target].append(i)
                self.where[i] = target
                self.fill[source] -= self.lengths[i]
                self.fill[target] += self.lengths[i]

    def _best_step(self, poor: int, pairs: np.ndarray, among: np.ndarray) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange of this bin with one of ``among`` with the largest growth of the sum of squares, if any grows it."""
        gap = np.where((self.fill > 0) & among, self.size - self.fill, 0)
        gap[poor] = 0
        near = np.flatnonzero(gap)
        if not len(near):
            return None
        ones, twos = self._parcels(poor)
        if len(near) <= 16:
            items = np.array([i for b in near.tolist() for i in self.members[b]], dtype=np.int64)
            pairs = self._pairs(near.tolist())
        else:
            items = np.flatnonzero(gap[self.where] > 0)
            pairs = pairs[gap[self.where[pairs[:, 0]]] > 0]
        offers = (  # what may come back: nothing, one item, two items
            (near, np.zeros(len(near), dtype=np.int64), lambda at: ()),
            (self.where[items], self.lengths[items], lambda at: (int(items[at]),)),
            (self.where[pairs[:, 0]], self.lengths[pairs].sum(axis=1), lambda at: tuple(pairs[at].tolist())),
        )
        best, found = 0, None
        for give in ones + twos:
            n = int(sum(self.lengths[i] for i in give))
            for where, length, chosen in offers[:3 if len(give) == 1 else 2]:
                more = n - length  # what the richer bin gains
                growth = np.where((more > 0) & (more <= gap[where]), more * (self.fill[where] - self.fill[poor] + more), 0)
                at = int(growth.argmax()) if len(growth) else 0
                if len(growth) and growth[at] > best:
                    best, found = int(growth[at]), (poor, int(where[at]), give, chosen(at))
        return found


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length."""
    bins = Bins(np.asarray(lengths, dtype=np.int64), size)
    bins.search()
    where, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for b, m in enumerate(bins.members):
        at = 0
        for i in m:
            where[i], offset[i] = b, at
            at += int(lengths[i])
    return where, offset


def pack(cut: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces.

    The pieces are stored once, so that the row ids by which groups are dealt hold.
    """
    rows = stored(cut.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    open_rows = rows.where(F.col("length") < size)
    groups = max(1, -(-open_rows.count() // group))
    dealt = open_rows.select("_uid", F.col("length").cast("bigint"), F.pmod(F.xxhash64("_uid"), F.lit(groups)).alias("_group"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_uid", ignore_index=True)
        where, offset = pack_lengths(pdf["length"].to_numpy(), size)
        # a group may hold more than ``group`` pieces, and no bin number reaches 2 ** 32
        return pd.DataFrame({"_uid": pdf["_uid"], "sequence_id": pdf["_group"] * 2**32 + where, "offset": offset})

    places = dealt.groupBy("_group").applyInPandas(packed, "_uid bigint, sequence_id bigint, offset bigint")
    full = rows.where(F.col("length") >= size).withColumns({
        "sequence_id": -1 - F.col("_uid"), "offset": F.lit(0).cast("bigint")
    })
    return open_rows.join(places, "_uid").unionByName(full).drop("_uid")


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence (packed bytes) from pieces that carry their ``ids``."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence at most
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None,
    doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack(pieces(docs, tokenizer_path, ranks_path, pattern, doc_id, text, size, end_id, with_ids), size)
