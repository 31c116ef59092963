"""Hash-consed segment trees over term ids, and prices of pairs of trees.

Many count vectors over the same terms become binary trees level by level in numpy: a node is
the pair of its halves, and equal nodes, of one tree or of several, are one.  Two trees are
priced by walking both at once from the roots; a pair of nodes met again at the same level by
two groups of the same size is priced once.
"""

from __future__ import annotations

import numpy as np

SCALE_DIGITS = 3  # shares are thousandths of thousandths of thousandths
LARGEST = (1 << 63) // 1000


def shares(counts: np.ndarray, totals: np.ndarray, terms: int, extra: int) -> np.ndarray:
    """1 + floor(10**9 * (count + extra) / (total + extra * terms)), exactly, by long division."""
    rest = counts.astype(np.int64) + extra
    whole = np.maximum(totals.astype(np.int64) + extra * terms, 1)
    if len(whole) and int(whole.max()) >= LARGEST:
        raise OverflowError("more than 9e15 terms in a group")
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(SCALE_DIGITS):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


class Forest:
    """Trees of the rows of *counts* (one row a group, one column a term).

    ``roots[g]`` is group g's root; ``levels[k]`` holds the two children of each distinct node
    of the k-th level from the top; ``leaves`` the count of each distinct leaf.
    """

    def __init__(self, counts: np.ndarray):
        groups, width = counts.shape
        self.depth = max(width - 1, 0).bit_length()
        # what a power of two has beyond the terms is a leaf of its own, priced at nothing
        full = np.full((groups, 1 << self.depth), -1, np.int64)
        full[:, :width] = counts
        self.leaves, node = np.unique(full, return_inverse=True)
        node = node.reshape(full.shape)
        self.levels: list[np.ndarray] = []
        for _ in range(self.depth):
            left, right = node[:, ::2], node[:, 1::2]
            keys, found = np.unique(left * (int(node.max(initial=0)) + 1) + right, return_inverse=True)
            base = int(node.max(initial=0)) + 1
            self.levels.insert(0, np.stack([keys // base, keys % base], axis=1))
            node = found.reshape(left.shape)
        self.roots = node[:, 0]

    def nodes(self) -> int:
        return sum(map(len, self.levels)) + len(self.leaves)

    def prices(self, a: np.ndarray, b: np.ndarray, totals: np.ndarray, terms: int, extra: int) -> tuple[np.ndarray, int]:
        """Sum of absolute differences of shares for each pair of groups (a, b), and how many node pairs were priced.

        The price of a node pair depends on the groups only through their totals.
        """
        sizes, size_of = np.unique(totals, return_inverse=True)
        at = np.stack([size_of[a], size_of[b], self.roots[a], self.roots[b]], axis=1)
        up, priced = [], 0
        at, back = np.unique(at, axis=0, return_inverse=True)
        up.append(back.reshape(-1))
        for level in self.levels:
            priced += len(at)
            halves = [np.column_stack([at[:, :2], level[at[:, 2], side], level[at[:, 3], side]]) for side in (0, 1)]
            at, back = unique_rows(np.concatenate(halves))
            up.append(back)
        priced += len(at)
        x, y = self.leaves[at[:, 2]], self.leaves[at[:, 3]]
        value = np.abs(shares(np.maximum(x, 0), sizes[at[:, 0]], terms, extra) - shares(np.maximum(y, 0), sizes[at[:, 1]], terms, extra))
        value[x < 0] = 0
        for back in up[:0:-1]:
            both = value[back]
            value = both[: len(both) // 2] + both[len(both) // 2:]
        return value[up[0]], priced


def unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of small non-negative numbers and the place of each row among them."""
    bases = rows.max(axis=0, initial=0).astype(object) + 1
    if np.prod(bases) >= 1 << 62:
        out, back = np.unique(rows, axis=0, return_inverse=True)
        return out, back.reshape(-1)
    key = np.zeros(len(rows), np.int64)
    for k, base in enumerate(bases):
        key = key * int(base) + rows[:, k]
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], back.reshape(-1)
