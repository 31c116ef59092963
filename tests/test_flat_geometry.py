"""Simplification of many rings at once, small boxes in one cell, bytes of listed files only."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators import matching as M
from scriptoria.sources import files


def one_ring(ring, ratio):
    """Douglas-Peucker with a stack, on a copy of the ring."""
    n = len(ring)
    tolerance = ratio * np.hypot(*(ring - np.roll(ring, -1, axis=0)).T).sum()
    first = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    second = int(np.argmax(((ring - ring[first]) ** 2).sum(axis=1)))
    keep = {first, second}
    pending = [(min(first, second), max(first, second)), (max(first, second), min(first, second) + n)]
    while pending:
        a, b = pending.pop()
        if b - a < 2:
            continue
        p, q = ring[a % n], ring[b % n]
        chord = q - p
        inner = [ring[k % n] - p for k in range(a + 1, b)]
        far = [np.hypot(*o) if np.hypot(*chord) == 0 else abs(chord[0] * o[1] - chord[1] * o[0]) / np.hypot(*chord) for o in inner]
        worst = int(np.argmax(far))
        if far[worst] > tolerance:
            keep.add((a + 1 + worst) % n)
            pending += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return ring[sorted(keep)] if n >= 3 and first != second and len(keep) >= 3 else ring


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=25), min_size=1, max_size=6), st.sampled_from([0.0, 0.005, 0.02, 0.1, 0.6]))
def test_many_rings_at_once(rings, ratio):
    arrays = [np.array(r, float).reshape(-1, 2) for r in rings]
    flat = np.concatenate(arrays)
    keep = G.simplify_rings(np.array([len(r) for r in rings]), flat[:, 0], flat[:, 1], ratio)
    for ring, mine in zip(arrays, np.split(keep, np.cumsum([len(r) for r in rings])[:-1]), strict=True):
        expected = one_ring(ring, ratio) if len(ring) else ring
        assert np.array_equal(ring[mine], expected)


def test_simplify_column(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [(int(x), int(y)) for x, y in rng.integers(0, 90, (n, 2))]) for i, n in enumerate([0, 1, 2, 3, 4, 40, 400])] + [(7, None)]
    df = spark.createDataFrame(rows, "i int, points array<struct<x:int,y:int>>").repartition(2)
    for r in df.select("*", G.simplify(F.col("points"), 0.02).alias("s")).collect():
        if r.points is None or len(r.points) < 3:
            assert r.s is None
        else:
            assert [tuple(p) for p in r.s] == [tuple(p) for p in one_ring(np.array(r.points, float), 0.02).astype(int).tolist()]


def boxes(seed, n, span, side):
    rng = random.Random(seed)
    return [(rng.randrange(3), i, x := rng.randrange(span), y := rng.randrange(span), x + rng.choice(side), y + rng.choice(side)) for i in range(n)]


@pytest.mark.parametrize(("cell", "fine"), [((2048, 256), (64, 16)), ((40, 30), (8, 8)), ((16, 16), (16, 16))])
def test_pairs_of_all_sizes(spark, cell, fine):
    a, b = boxes(1, 150, 300, [0, 3, 7, 8, 20, 90]), boxes(2, 150, 300, [0, 3, 7, 8, 20, 90])
    g, p = (spark.createDataFrame(rows, f"page_id long, {idx} int, x1 int, y1 int, x2 int, y2 int") for rows, idx in ((a, "gt_idx"), (b, "pred_idx")))
    got = [(r.page_id, r.gt_idx, r.pred_idx) for r in M.candidate_pairs(g, p, cell=cell, fine=fine).collect()]
    want = {(u[0], u[1], v[1]) for u in a for v in b if u[0] == v[0] and u[2] <= v[4] and v[2] <= u[4] and u[3] <= v[5] and v[3] <= u[5]}
    assert len(got) == len(set(got)) and set(got) == want


def test_many_small_boxes_in_one_coarse_cell(spark):
    n = 50_000
    at = F.col("id") % 500 * 4, F.floor(F.col("id") / 500) * 2
    grid = spark.range(n).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("i"), at[0].cast("int").alias("x1"), at[1].cast("int").alias("y1"))
    rows = grid.withColumn("x2", F.col("x1") + 2).withColumn("y2", F.col("y1") + 1)
    start = time.time()
    assert M.candidate_pairs(rows.withColumnRenamed("i", "gt_idx"), rows.withColumnRenamed("i", "pred_idx")).count() == n
    assert time.time() - start < 60


def test_only_listed_files_are_opened(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"p{i}.jpg").write_bytes(bytes([i]))
    odd = tmp_path / "a [1] {b}*.jpg"
    odd.write_bytes(b"odd")
    rows = spark.createDataFrame([(f"file:{tmp_path}/p3.jpg", "x"), (f"file:{odd}", "y")], "path string, split string")
    found = files.bytes_of_paths(spark, rows.collect(), rows.schema)
    assert len(found.inputFiles()) == 2
    assert {bytes(r.content) for r in found.collect()} == {b"\x03", b"odd"}
    with pytest.raises(ValueError):
        files.bytes_of_paths(spark, [rows.first()] * (files.PATHS_AT_ONCE + 1), rows.schema)


@pytest.mark.parametrize("bounded", [False, True])
def test_polygon_overlap_equals_filled_spans(spark, bounded):
    from scriptoria.operators import spans as R

    rng = np.random.default_rng(9)
    line = lambda: [(int(x), int(y)) for x, y in rng.integers(-10, 40, (rng.integers(1, 9), 2))]
    made = lambda idx: spark.createDataFrame([(p, i, line()) for p in range(4) for i in range(12)] + [(9, 0, [])], f"page_id long, {idx} int, points array<struct<x:int,y:int>>")
    g, p = made("gt_idx"), made("pred_idx")
    size = spark.createDataFrame([(i, 20 + i, 25) for i in range(4)], "page_id long, width int, height int") if bounded else None

    def filled(df, idx):
        rows = R.fill_polygons(df) if size is None else R.fill_polygons(df.join(size, "page_id"), bounds=("width", "height"))
        return rows.select("page_id", idx, "y", "x0", "x1")

    want = {(r.page_id, r.gt_idx, r.pred_idx): (r.inter, r.union, r.iou) for r in M.span_overlap(filled(g, "gt_idx"), filled(p, "pred_idx")).collect()}
    got = {(r.page_id, r.gt_idx, r.pred_idx): (r.inter, r.union, r.iou) for r in M.polygon_overlap(g, p, size).collect()}
    assert got == want and len(got) > 100
    some = {k for k, v in want.items() if v[2] >= 0.2}
    assert {(r.page_id, r.gt_idx, r.pred_idx) for r in M.polygon_overlap(g, p, size, min_iou=0.2).collect()} == some


def test_ious_of_many_pairs_at_once():
    rng = np.random.default_rng(17)
    a_sizes, b_sizes = rng.integers(0, 8, 400), rng.integers(0, 8, 400)
    a_sizes[7] = 1000  # beyond the cells of one step, on its own
    a, b = (rng.integers(0, 12, (n.sum(), 2)).astype(float) for n in (a_sizes, b_sizes))
    found = G.rings_iou(a_sizes, *a.T, b_sizes, *b.T)
    expected = [G.ring_iou(x, y) for x, y in zip(np.split(a, np.cumsum(a_sizes)[:-1]), np.split(b, np.cumsum(b_sizes)[:-1]))]
    assert np.allclose(found, expected, rtol=0, atol=1e-12) and (found > 0).sum() > 50
