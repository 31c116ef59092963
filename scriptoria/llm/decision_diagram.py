"""Count-weighted decision diagrams over filters, reordered by swaps of adjacent levels.

A node of level i decides the filter that stands at place i of the order: its low edge is
passing, its high edge failing.  Nodes with equal edges on one level are one node, and so are
equal leaves, which hold the counts of a mask; every node carries the sum of what lies below.
"""

from __future__ import annotations

from collections.abc import Iterator

Counts = tuple[int, ...]


def orders_by_swaps(n: int) -> Iterator[int]:
    """Places i, each to be swapped with i + 1, that lead through all n! orders (Steinhaus, Johnson, Trotter)."""
    if n < 2:
        return
    inner = orders_by_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # the largest element stands at the left end after a walk down, else at the right one
        yield step + 1 if down else step
        down = not down


class Diagram:
    """The diagram of one part: ``masks`` gives the counts of each mask, bit i for filter i."""

    def __init__(self, n: int, masks: dict[int, Counts]):
        self.order = list(range(n))
        width = len(next(iter(masks.values()), ()))
        zero = (0,) * width
        self.weight: list[Counts] = []
        self.low: list[int] = []
        self.high: list[int] = []
        leaves: dict[Counts, int] = {}
        # level i of the first order decides bit i, so the last level tells masks by the highest bit
        below = []
        for k in range(1 << n):
            mask = int(f"{k:0{n}b}"[::-1], 2) if n else 0
            counts = masks.get(mask, zero)
            if counts not in leaves:
                leaves[counts] = self._new(counts, -1, -1)
            below.append(leaves[counts])
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        for level in range(n - 1, -1, -1):
            below = [self._node(level, a, b) for a, b in zip(below[::2], below[1::2], strict=True)]
        self.root = below[0]

    def _new(self, weight: Counts, low: int, high: int) -> int:
        self.weight.append(weight)
        self.low.append(low)
        self.high.append(high)
        return len(self.weight) - 1

    def _node(self, level: int, low: int, high: int) -> int:
        unique = self.levels[level]
        if (low, high) not in unique:
            total = tuple(a + b for a, b in zip(self.weight[low], self.weight[high], strict=True))
            unique[low, high] = self._new(total, low, high)
        return unique[low, high]

    def swap(self, level: int) -> None:
        """Exchange the filters of *level* and the next; nodes of *level* keep what they stand for, the next one is made anew."""
        held = self.levels[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        for (low, high), node in held.items():
            a = self._node(level + 1, self.low[low], self.low[high])
            b = self._node(level + 1, self.high[low], self.high[high])
            self.low[node], self.high[node] = a, b
            self.levels[level][a, b] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[int, Counts, Counts]]:
        """Filter, counts of what it removes and of what stays, at each step of the order."""
        node = self.root
        for f in self.order:
            yield f, self.weight[self.high[node]], self.weight[self.low[node]]
            node = self.low[node]

    def size(self) -> int:
        return sum(map(len, self.levels))
