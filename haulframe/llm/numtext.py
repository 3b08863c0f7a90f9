"""Words of many texts at once, as numbers.

Texts are UTF-8 bytes. Words are runs of bytes other than ASCII white space. A word
or a run of words is a 64-bit hash, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000  # bytes of text per numpy step; a longer text is a step of its own

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20_240_117))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E37_79B9_7F4A_7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some texts: ``hash``, ``doc`` (its text's number), ``start`` and ``end`` in ``buf``."""

    def __init__(self, texts: list[bytes], letters: np.ndarray = AS_IS):
        self.n_docs = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        self.inside = ~SPACE[self.buf]
        edge = np.diff(np.concatenate(([False], self.inside)).view(np.int8)) if len(self.buf) else np.zeros(0, dtype=np.int8)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)  # every text is followed by a line break
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.doc_end = np.cumsum(lengths)
        self.doc_start = self.doc_end - lengths
        self.doc = np.searchsorted(self.doc_end, self.start, "right")
        up, down = _powers_to(len(self.buf) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[letters[self.buf]] * up[:-1], dtype=np.uint64)))
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def per_doc(self, at: np.ndarray) -> np.ndarray:
        """Number of words per text among the given word numbers (or a mask)."""
        return np.bincount(self.doc[at], minlength=self.n_docs)

    def count_bytes(self, chosen: np.ndarray) -> np.ndarray:
        """Number of chosen bytes per text."""
        sums = np.concatenate(([0], np.cumsum(chosen)))
        return sums[self.doc_end] - sums[self.doc_start]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a text, and the number of their first word."""
        last = len(self.hash) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1:])
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            total = mix(total + self.hash[at + k] * np.uint64(2 * k + 3))
        return total, at

    def repeated(self, n: int) -> np.ndarray:
        """Mask of words that lie in a run of ``n`` words found twice or more in their text."""
        runs, at = self.runs(n)
        _, which, count = np.unique(
            mix(runs + mix(self.doc[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True
        )
        edges = np.zeros(len(self.hash) + 1, dtype=np.int64)
        first = at[count[which] > 1]
        edges[first] += 1
        edges[first + n] -= 1  # first words are distinct, so are these
        return np.cumsum(edges[:-1]) > 0


def parts(batches: Iterator[pa.RecordBatch], *columns: str, size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, about ``size`` bytes of the given text columns at a time.

    A batch holds a fixed number of rows, however long their texts are; what Python makes of
    them shall not.
    """
    for batch in batches:
        total = np.zeros(batch.num_rows, dtype=np.int64)
        for c in columns:
            total += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(total) // size)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, with the number of their first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield begin, texts[begin:i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
