"""Sweeps over the runs of pixel rows against painting pixels."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.operators import spans as R

PIECE = st.tuples(st.integers(0, 40), st.integers(0, 15), st.integers(0, 6))


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=25))
def test_sweep_of_one_row(pieces):
    rows = sorted((a, a + n, i) for a, n, i in pieces)
    got = R.sweep_row(*map(list, zip(*rows)))
    want = {}
    for a, b, i in rows:
        for x in range(a, b + 1):
            want[x] = max(want.get(x, i), i)
    assert {x: i for a, b, i in got for x in range(a, b + 1)} == want
    assert sum(b - a + 1 for a, b, _ in got) == len(want) and len(got) <= 2 * len(rows)


def test_many_instances_on_one_row(spark):
    n = 10_000
    rng = random.Random(1)
    rows = [(1, i, 0, a, a + rng.randrange(200, 900)) for i, a in enumerate(rng.choices(range(60_000), k=n))]
    df = spark.createDataFrame(rows, "page_id long, inst_id int, y int, x0 int, x1 int")
    start = time.time()
    owner = [(r.x0, r.x1, r.inst_id) for r in R.instance_map(df, cell=1 << 20).collect()]
    touching = R.spans_to_pixels(R.touching_boundary(spark.createDataFrame([(1, i, y, a, b) for a, b, i in owner for y in (0, 1)], df.schema))).count()
    assert time.time() - start < 60
    painted = np.full(61_000, -1)
    for _, i, _, a, b in rows:
        painted[a:b + 1] = np.maximum(painted[a:b + 1], i)
    got = np.full(61_000, -1)
    for a, b, i in owner:
        got[a:b + 1] = i
    assert np.array_equal(painted, got)
    differs = (painted[1:] != painted[:-1]) & (painted[1:] >= 0) & (painted[:-1] >= 0)
    assert touching == 2 * (np.append(differs, False) | np.append(False, differs)).sum()


@pytest.mark.parametrize("wrap", [False, True])
def test_boundaries_equal_pixels(spark, wrap):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for page, (h, w) in enumerate([(7, 9), (1, 6), (6, 1), (2, 5), (12, 30)]):
        owner = rng.integers(-1, 4, (h, w))
        for y, x in np.ndindex(h, w):
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                v, u = y + dy, x + dx
                if wrap:
                    v, u = v % h, u % w
                elif not (0 <= v < h and 0 <= u < w):
                    continue
                if owner[y, x] >= 0 and owner[v, u] >= 0 and owner[v, u] != owner[y, x]:
                    want.add((page, y, x))
            if owner[y, x] >= 0:
                rows.append((page, int(owner[y, x]), y, x, x, h, w))
    df = spark.createDataFrame(rows, "page_id long, inst_id int, y int, x0 int, x1 int, height int, width int")
    merged = R.merge_spans(df.drop("height", "width"), ["page_id", "inst_id"]).join(df.select("page_id", "height", "width").distinct(), "page_id")
    for runs in (df, merged):
        found = R.touching_boundary(runs, ("height", "width") if wrap else None)
        assert {(r.page_id, r.y, r.x) for r in R.spans_to_pixels(found).collect()} == want
