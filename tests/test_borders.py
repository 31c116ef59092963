"""Outlines from run ends against following the border pixel by pixel."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.operators import components as C
from scriptoria.operators.borders import run_outlines
from scriptoria.operators.spans import fill_polygons
from scriptoria.sources.images import runs

AROUND = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def followed(pixels):
    """Corners (x, y) of the border through the first pixel, clockwise."""
    start = min(pixels)

    def step(at, begin):
        return next((d for k in range(8) if (at[0] + AROUND[d := (begin + k) % 8][0], at[1] + AROUND[d][1]) in pixels), None)

    first = step(start, 1)
    if first is None:
        return [start[::-1]]
    at, d, path, moves = start, first, [], []
    while True:
        path.append(at[::-1])
        moves.append(d)
        at = at[0] + AROUND[d][0], at[1] + AROUND[d][1]
        d = step(at, (d + 5) % 8)
        if at == start and d == first:
            return [p for i, p in enumerate(path) if moves[i] != moves[i - 1]]


def parts(mask):
    y, x0, x1 = runs(mask)
    root = C.label_sorted_spans(np.zeros(len(y), int), y, x0, x1)
    order = np.lexsort((x0, y, root))
    return np.unique(root[order], return_inverse=True)[1], y[order], x0[order], x1[order]


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([0.3, 0.5, 0.7, 0.9]), st.integers(0, 10**6))
def test_outlines_follow_the_border(h, w, share, seed):
    mask = np.random.default_rng(seed).random((h, w)) < share
    if not mask.any():
        return
    comp, y, x0, x1 = parts(mask)
    of, px, py = run_outlines(comp, y, x0, x1)
    for c in range(comp.max() + 1):
        pixels = {(int(y[i]), int(x)) for i in np.flatnonzero(comp == c) for x in range(x0[i], x1[i] + 1)}
        assert list(zip(px[of == c].tolist(), py[of == c].tolist())) == followed(pixels)


def test_a_large_spiral_and_a_comb():
    comb = np.ones((400, 1001), bool)
    comb[1:, 1::2] = False
    of, px, py = run_outlines(*parts(comb))
    y, x = np.nonzero(comb)
    assert list(zip(px.tolist(), py.tolist())) == followed(set(zip(y.tolist(), x.tolist())))


def test_filled_again(spark):
    rng = np.random.default_rng(4)
    rows = [(p, int(y), int(a), int(b)) for p in range(5) for y, a, b in zip(*runs(rng.random((60, 50)) < 0.55))]
    labelled = C.components(spark.createDataFrame(rows, "page_id long, y int, x0 int, x1 int"))
    stats = {(r.page_id, r.comp): r for r in C.component_stats(labelled).collect()}
    again = {(r.page_id, r.comp): r for r in C.component_stats(fill_polygons(C.outlines(labelled))).collect()}
    assert stats.keys() == again.keys()
    for k, r in stats.items():
        assert (r.left, r.top, r.width, r.height) == (again[k].left, again[k].top, again[k].width, again[k].height) and r.area <= again[k].area
