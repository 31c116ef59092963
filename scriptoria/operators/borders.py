"""Outlines of components from the ends of their runs.

The border of a mask is made of the left and right edges of its runs and of level pieces
between rows.  On the line between two rows the x of all edge ends, in order, pair off: the
first with the second, the third with the fourth, and so on, since the rows differ exactly
between the two of a pair.  Where two runs touch at a corner only, the order of the two ends
decides that they stay together.  Pairs chain the edges into rings; the ring through the left
edge of a component's first run is its outer border, others are holes.
"""

from __future__ import annotations

import numpy as np


def _rank_along(following: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every edge the start edge its ring comes back to and the steps to there; -1 on rings without a start.

    Pointers are doubled, so a ring of n edges takes log n rounds.
    """
    n = len(following)
    jump, steps = following.copy(), np.ones(n, np.int64)
    at_start = np.zeros(n, bool)
    at_start[start] = True
    while True:
        open_ = np.flatnonzero(~at_start[jump])
        if not len(open_) or int(steps.max()) > n:
            break
        steps[open_] += steps[jump[open_]]
        jump[open_] = jump[jump[open_]]
    return np.where(at_start[jump], jump, -1), steps


def run_outlines(comp: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners (number of the component, x, y) of the outer border of 8-connected components.

    Runs are maximal and sorted by comp, y, x0, with *comp* counting from 0 without gaps.
    Corners follow the border clockwise from the first pixel of the component.
    """
    n = len(y)
    comp, y, x0, x1 = (v.astype(np.int64) for v in (comp, y, x0, x1))
    # edges 0..n-1 are left ones, which lead up, n..2n-1 right ones, which lead down
    run = np.tile(np.arange(n), 2)
    right = np.repeat([False, True], n)
    x = np.concatenate([x0, x1 + 1])
    edge = np.tile(np.arange(2 * n), 2)
    line = np.concatenate([y[run], y[run] + 1])  # the upper end of each edge, then the lower one
    order = np.lexsort((right[edge], x[edge], line, comp[run[edge]]))
    partner = np.empty(4 * n, np.int64)
    partner[order[0::2]], partner[order[1::2]] = order[1::2], order[0::2]
    leaving = np.where(right, np.arange(2 * n) + 2 * n, np.arange(2 * n))  # right edges are left at their lower end
    following = edge[partner[leaving]]
    level = line[leaving]

    first = np.flatnonzero(np.append(True, comp[1:] != comp[:-1]))
    start, steps = _rank_along(following, first)
    outer = np.flatnonzero(start >= 0)
    # a start edge is whole ring steps away from itself and comes first
    outer = outer[np.lexsort((-steps[outer], start[outer]))]
    from_x, to_x, at = x[outer], x[following[outer]], level[outer]
    rightward, leftward = to_x > from_x, to_x < from_x
    own_x, own_y = np.where(right[outer], x1[run[outer]], x0[run[outer]]), y[run[outer]]
    # the pixels beside the level piece: below it on the way right, above it on the way left
    beside_y = np.where(rightward, at, np.where(leftward, at - 1, own_y))
    near_x = np.where(rightward, from_x, np.where(leftward, from_x - 1, own_x))
    far_x = np.where(rightward, to_x - 1, np.where(leftward, to_x, own_x))
    px = np.column_stack([own_x, near_x, far_x]).ravel()
    py = np.column_stack([own_y, beside_y, beside_y]).ravel()
    of = np.repeat(comp[run[outer]], 3)

    # of equal points in a row, around the ring, the last
    of, px, py = _without(px, py, of, lambda bx, by, ax, ay: (ax == 0) & (ay == 0))
    # only pixels where the direction changes
    return _without(px, py, of, lambda bx, by, ax, ay: (np.sign(bx) == np.sign(ax)) & (np.sign(by) == np.sign(ay)))


def _without(px: np.ndarray, py: np.ndarray, of: np.ndarray, idle) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings without the points that are idle by the steps before and after them; a ring keeps a point."""
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    ends = np.append(cuts[1:], len(of)) - 1
    before, after = np.arange(len(of)) - 1, np.arange(len(of)) + 1
    before[cuts], after[ends] = ends, cuts
    drop = idle(px - px[before], py - py[before], px[after] - px, py[after] - py)
    keep = ~drop
    alone = np.add.reduceat(keep, cuts) == 0 if len(cuts) else np.zeros(0, bool)
    keep[cuts[alone]] = True
    return of[keep], px[keep], py[keep]
