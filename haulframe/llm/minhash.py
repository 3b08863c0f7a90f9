"""MinHash signatures and chosen paths, for many sets at once.

A signature is ``k`` 16-bit numbers; two sets agree in one of them with the chance of
their Jaccard similarity (and by accident once in 65,536 times).
"""

from __future__ import annotations

import numpy as np

#: Numbers that a level of a tree has to itself.
CHOICES = 4

_random = np.random.Generator(np.random.PCG64(31_415))
_FACTOR = _random.integers(0, 2**32, 256, dtype=np.uint32) | np.uint32(1)
_OFFSET = _random.integers(0, 2**32, 256, dtype=np.uint32)


def _functions(draw: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    if not draw:
        return _FACTOR, _OFFSET
    random = np.random.Generator(np.random.PCG64([31_415, draw]))
    return random.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), random.integers(0, 2**32, k, dtype=np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray, k: int, draw: int = 0) -> np.ndarray:
    """One row of ``k`` numbers per set; ``first`` are the places where the (non-empty) sets begin.

    Another ``draw`` takes other hash functions.
    """
    factor, offset = _functions(draw, k)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), k), dtype="<u2")
    if len(first):
        for i in range(k):
            low = np.minimum.reduceat(h * factor[i] + offset[i], first)
            out[:, i] = (low * np.uint32(0x9E37_79B1)) >> np.uint32(16)
    return out


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Share of equal numbers in pairs of signatures."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(len(s), -1) for s in (a, b))
    return (x == y).mean(axis=1)


def least_agreement(similarity: float, k: int, deviations: float = 5.0) -> float:
    """Agreement that a pair of this similarity falls below with a chance of under 1 in 300,000 (``k`` of 192)."""
    return similarity - deviations * (similarity * (1 - similarity) / k) ** 0.5


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return bool(100 * common >= percent * (len(a) + len(b) - common) and common)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58_476D_1CE4_E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> np.uint64(31))


def branch(numbers: np.ndarray, row: np.ndarray, node: np.ndarray, tree: np.ndarray, more: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level of chosen paths: (row, node, tree) of the children that the sets in ``row`` go to.

    ``numbers`` has ``CHOICES`` minwise numbers of each tree for this level. A node chooses one of them by its
    own key, and another with the chance ``more``. Every set goes to the children named by its numbers there.
    """
    choices = np.uint64(CHOICES)
    one = _mix(node) % choices
    again = _mix(node + np.uint64(0x51ED_270B)).astype(np.float64) < more * 2.0**64
    two = (one + np.uint64(1) + _mix(node + np.uint64(77)) % (choices - np.uint64(1)))[again] % choices

    def child(rows, nodes, trees, at):
        number = numbers[rows, trees * CHOICES + at.astype(np.int64)].astype(np.uint64)
        return _mix(nodes ^ _mix((at << np.uint64(32)) + number + np.uint64(1)))

    return (
        np.concatenate((row, row[again])),
        np.concatenate((child(row, node, tree, one), child(row[again], node[again], tree[again], two))),
        np.concatenate((tree, tree[again])),
    )


def leaves(sig: np.ndarray, trees: int, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the given depth in every tree: (row, node, tree). A pair of this similarity is expected in one child of a node.

    ``sig`` has the numbers of one level after the other.
    """
    row = np.tile(np.arange(len(sig)), trees)
    tree = np.repeat(np.arange(trees, dtype=np.int64), len(sig))
    node, width = _mix(tree.astype(np.uint64) + np.uint64(1)), trees * CHOICES
    for level in range(depth):
        row, node, tree = branch(sig[:, level * width:(level + 1) * width], row, node, tree, 1 / similarity - 1)
    return row, node, tree
