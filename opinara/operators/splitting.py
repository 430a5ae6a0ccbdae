"""Exact n-out-of-n bootstrap counts made in place, by splitting a multinomial down a tree.

The n draws of a replicate fall on the dense row indices [0, n). A node is a range of indices with a number of draws;
the left half gets a binomial share of them with the probability of its size, the right half the rest, down to leaves
of at most ``LEAF`` rows, whose draws fall on their rows evenly. Shares are drawn by a counter-based generator keyed
by (seed, range, replicates), so every task finds the counts of its own rows by walking from the root to its leaves,
with the same result wherever and however often it runs. Nothing is shuffled and counts add up to n exactly.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np

LEAF = 4096
#: Nodes that a task remembers; a walk in order of the indices finds nearly all of its path among them.
REMEMBERED = 4096


def generator(seed: int, low: int, high: int, rep: int, leaf: bool) -> np.random.Generator:
    """Random numbers of one node and block of replicates."""
    key = np.random.SeedSequence([seed & (1 << 64) - 1, low, high, rep, int(leaf)])
    return np.random.Generator(np.random.Philox(key))


def leaf_of(ids: np.ndarray, n: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the leaf that holds each index."""
    low, high = np.zeros(len(ids), np.int64), np.full(len(ids), n, np.int64)
    while True:
        open_ = high - low > leaf
        if not open_.any():
            return low, high
        middle = (low + high) // 2
        right = ids >= middle
        low, high = np.where(open_ & right, middle, low), np.where(open_ & ~right, middle, high)


class Splitter:
    """Counts of rows by replicate; ``reps`` of a call must be consecutive, and the same numbers in every task."""

    def __init__(self, n: int, seed: int, leaf: int = LEAF):
        self.n, self.seed, self.leaf = n, seed, leaf
        self.known: OrderedDict[tuple[int, int, int], np.ndarray] = OrderedDict()

    def node(self, low: int, high: int, reps: np.ndarray) -> np.ndarray:
        """Draws of each replicate that fall in [low, high)."""
        key = (low, high, int(reps[0]))
        if key in self.known:
            self.known.move_to_end(key)
            return self.known[key]
        a, b, count = 0, self.n, np.full(len(reps), self.n, np.int64)
        while (a, b) != (low, high):
            middle = (a + b) // 2
            left = self.known.get((a, middle, key[2]))
            if left is None:
                left = generator(self.seed, a, b, key[2], False).binomial(count, (middle - a) / (b - a))
                self._keep((a, middle, key[2]), left)
                self._keep((middle, b, key[2]), count - left)
            if high <= middle:
                b, count = middle, left
            else:
                a, count = middle, count - left
        self._keep(key, count)
        return count

    def _keep(self, key: tuple[int, int, int], count: np.ndarray) -> None:
        self.known[key] = count
        while len(self.known) > REMEMBERED:
            self.known.popitem(last=False)

    def counts(self, low: int, high: int, reps: np.ndarray) -> np.ndarray:
        """How often each row of a leaf is drawn, replicate by row."""
        draws, size = self.node(low, high, reps), high - low
        row = generator(self.seed, low, high, int(reps[0]), True).integers(0, size, int(draws.sum()))
        rep = np.repeat(np.arange(len(reps)), draws)
        return np.bincount(rep * size + row, minlength=len(reps) * size).reshape(len(reps), size)

    def __call__(self, reps: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        low, high = leaf_of(ids, self.n, self.leaf)
        for first in np.unique(low).tolist():
            at = np.flatnonzero(low == first)
            yield at, self.counts(first, int(high[at[0]]), reps)[:, ids[at] - first]
