"""Hand-made edge cases and properties checked against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions import scalars as S
from scriptoria.sources import images
from scriptoria.operators.borders import run_outlines
from scriptoria.operators import components as C
from scriptoria.operators import lines as L
from scriptoria.operators import matching as M
from scriptoria.operators import memory, metrics
from scriptoria.operators import selection as sel
from scriptoria.operators import spans as R
from scriptoria.operators import tiles as T
from scriptoria.operators.joins import contains_join
from scriptoria.sources import notes


def boxes(spark, idx, rows):
    data = [(p, i, *b) for p, i, b in rows]
    return spark.createDataFrame(data, f"page_id long, {idx} int, x1 int, y1 int, x2 int, y2 int")


def score(spark, gt, pred, fold_limit=1000):
    g, p = boxes(spark, "gt_idx", gt), boxes(spark, "pred_idx", pred)
    m = M.greedy_match(M.box_overlap(M.candidate_pairs(g, p)), 0.75, fold_limit=fold_limit)
    return {r.page_id: r for r in M.page_scores(M.line_counts(g, p), m).collect()}, sorted((r.gt_idx, r.pred_idx) for r in m.collect())


def test_two_lines_want_one_prediction(spark):
    gt = [(1, 0, (0, 0, 99, 29)), (1, 1, (0, 2, 99, 31))]
    pred = [(1, 0, (0, 1, 99, 30)), (1, 1, (0, 4, 99, 33))]
    for limit in (1000, 0):
        scores, pairs = score(spark, gt, pred, limit)
        assert pairs == [(0, 0), (1, 1)]
        assert (scores[1].M, scores[1].DR, scores[1].FM) == (2, 1.0, 1.0)


def test_ties_go_to_the_lower_index(spark):
    _, pairs = score(spark, [(1, 0, (0, 0, 9, 9))], [(1, 0, (0, 0, 9, 9)), (1, 1, (0, 0, 9, 9))])
    assert pairs == [(0, 0)]


def test_empty_side_scores_zero(spark):
    scores, _ = score(spark, [(1, 0, (0, 0, 9, 9))], [(2, 0, (0, 0, 9, 9))])
    assert [(r.N_gt, r.N_pred, r.DR, r.RA, r.FM) for r in (scores[1], scores[2])] == [(1, 0, 0, 0, 0), (0, 1, 0, 0, 0)]


def test_pairs_over_cell_borders_come_once(spark):
    gt = [(1, 0, (0, 0, 5000, 900))]
    pred = [(1, 0, (100, 100, 6000, 1000)), (1, 1, (5001, 0, 5100, 10))]
    pairs = M.candidate_pairs(boxes(spark, "gt_idx", gt), boxes(spark, "pred_idx", pred), cell=(64, 32))
    assert [(r.gt_idx, r.pred_idx) for r in pairs.collect()] == [(0, 0)]


NOTE = [
    "  Grayscale variance method:", "    Image 1: a_max.jpg (variance: 7333.80)", "", "    Image 2: b.jpg",
    "PCA max distance method:", "    Image 0: c.jpg", "  Grayscale variance method:", "    Image 3: d.jpg", "    Image 4: e.png",
]


@pytest.mark.parametrize("indent,want", [("", ["a_max", "b", "d"]), ("  ", ["a_max", "b", "c", "d"])])
def test_selection_notes(spark, indent, want):
    lines = [indent + t if t.startswith("PCA") else t for t in NOTE]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file_id string, n int, line string")
    got = [r.stem for r in notes.listed_pages(df, k=10).orderBy("rank").collect()]
    assert got == want
    assert [r.stem for r in notes.listed_pages(df, k=2).orderBy("rank").collect()] == want[:2]


@pytest.mark.parametrize("h,w", [(512, 512), (1280, 1280), (200, 600), (1000, 700)])
def test_tiles(spark, h, w):
    want = []
    for y, x in itertools.product(range(0, h, 384), range(0, w, 384)):
        y_end, x_end = min(h, y + 512), min(w, x + 512)
        y0 = max(0, y_end - 512 if y_end == h else y)
        x0 = max(0, x_end - 512 if x_end == w else x)
        if y_end - y0 >= 224 and x_end - x0 >= 224:
            want.append((y, x, y0, y_end, x0, x_end))
    df = spark.createDataFrame([(1, w, h)], "page_id long, width int, height int")
    got = [(r.y, r.x, r.y_start, r.y_end, r.x_start, r.x_end) for r in T.page_tiles(df).collect()]
    assert sorted(got) == sorted(want)


def test_windows_cover_the_page(spark):
    df = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate([(100, 100), (448, 448), (449, 1000), (1300, 700)])], "page_id long, width int, height int")
    for page in df.collect():
        wins = T.inference_windows(df.filter(F.col("page_id") == page.page_id)).collect()
        seen = np.zeros((page.height, page.width), bool)
        for r in wins:
            seen[r.y0 : r.y0 + r.hy, r.x0 : r.x0 + r.hx] = True
        assert seen.all()


def test_row_suppression_case(spark):
    ys = [(0, 10), (0.1, 10), (0, 20), (30, 40), (30, 40.3)]
    df = spark.createDataFrame([(1, i, 0.0, float(a), 5.0, float(b)) for i, (a, b) in enumerate(ys)], "page_id long, pred_idx int, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.pred_idx for r in L.suppress_rows(df).collect()) == [0, 2, 4]


def on_or_in(poly, px, py):
    inside = False
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if cross == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return True
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def random_polygons(n, seed):
    rng = random.Random(seed)
    fixed = [[(5, 5), (15, 5), (15, 9), (5, 9)], [(5, 5), (25, 5), (25, 20), (15, 8), (5, 20)], [(3, 4), (9, 4)], [(2, 2)]]
    return fixed + [[(rng.randrange(30), rng.randrange(24)) for _ in range(rng.randrange(3, 9))] for _ in range(n)]


def test_fill_equals_point_test(spark):
    polys = random_polygons(40, 7)
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(polys)], "page_id long, points array<struct<x:int,y:int>>")
    spans = R.fill_polygons(df)
    got = {(r.page_id, r.y, r.x) for r in R.spans_to_pixels(spans).collect()}
    want = {(i, y, x) for i, p in enumerate(polys) for y in range(25) for x in range(31) if on_or_in(p, x, y)}
    assert got == want
    rows = spans.orderBy("page_id", "y", "x0").collect()
    for a, b in zip(rows, rows[1:]):
        assert (a.page_id, a.y) != (b.page_id, b.y) or b.x0 > a.x1 + 1  # maximal runs


def test_contains_point_agrees(spark):
    polys = random_polygons(15, 8)
    grid = [(i, [{"x": a, "y": b} for a, b in p], x, y) for i, p in enumerate(polys) for x in range(0, 30, 3) for y in range(0, 24, 2)]
    df = spark.createDataFrame(grid, "i int, points array<struct<x:int,y:int>>, px int, py int")
    for r in df.withColumn("inside", G.contains_point(F.col("points"), F.col("px"), F.col("py"))).collect():
        assert r.inside == on_or_in(polys[r.i], r.px, r.py)


def test_polygon_iou_properties():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    assert G.ring_iou(square, square) == pytest.approx(1.0)
    assert G.ring_iou(square, square + [5, 0]) == pytest.approx(50 / 150)
    assert G.ring_iou(square, square + [20, 0]) == 0.0
    bow = np.array([(0, 0), (10, 10), (10, 0), (0, 10)], float)
    assert G.ring_iou(bow, square) == pytest.approx(0.5)
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.uniform(0, 10, (5, 2)), rng.uniform(0, 10, (6, 2))
        assert 0 <= G.ring_iou(a, b) <= 1
        assert G.ring_iou(a, b) == pytest.approx(G.ring_iou(b, a))


def test_simplify_keeps_corners_only():
    ring = np.array([(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (5, 10), (0, 10), (0, 5)], float)
    assert {tuple(p) for p in G.simplify_ring(ring, 0.01)} == {(0, 0), (10, 0), (10, 10), (0, 10)}
    assert len(G.simplify_ring(ring[:2], 0.01)) == 2


def test_instance_map_overwrites(spark):
    rng = random.Random(4)
    rows = [(1, i + 1, rng.randrange(6), a := rng.randrange(60), a + rng.randrange(40)) for i in range(60)]
    canvas = {}
    for _, inst, y, x0, x1 in rows:
        for x in range(x0, x1 + 1):
            canvas[y, x] = inst
    df = spark.createDataFrame(rows, "page_id long, inst_id int, y int, x0 int, x1 int")
    for cell in (16, 1024):
        got = {(r.y, r.x): r.inst_id for r in R.spans_to_pixels(R.instance_map(df, cell)).collect()}
        assert got == canvas


def test_touching_boundary_wraps_only_on_request(spark):
    rows = [(1, 1, 0, 0, 1, 3, 4), (1, 2, 2, 3, 3, 3, 4), (1, 3, 0, 3, 3, 3, 4)]
    df = spark.createDataFrame(rows, "page_id long, inst_id int, y int, x0 int, x1 int, height int, width int")
    plain = {(r.y, r.x) for r in R.spans_to_pixels(R.touching_boundary(df)).collect()}
    wrapped = {(r.y, r.x) for r in R.spans_to_pixels(R.touching_boundary(df, ("height", "width"))).collect()}
    assert plain == set()
    assert wrapped == {(0, 0), (0, 3), (2, 3)}


def dense_close(mask, kernel, iterations):
    def dilate(m):
        out = np.zeros_like(m)
        for y, x in np.argwhere(m):
            for dy, lo, hi in kernel:
                if 0 <= y - dy < m.shape[0]:
                    out[y - dy, max(x - hi, 0) : max(min(x - lo, m.shape[1] - 1) + 1, 0)] = True
        return out

    for _ in range(iterations):
        mask = dilate(mask)
    back = ~mask
    for _ in range(iterations):
        back = dilate(back)
    return ~back


@pytest.mark.parametrize("kernel,iterations", [(R.rect_kernel(7, 3), 1), (R.ellipse_kernel(6, 6), 2)])
def test_closing_equals_dense(spark, kernel, iterations):
    mask = np.random.default_rng(2).random((25, 30)) < 0.12
    rows = [(1, int(y), int(x)) for y, x in np.argwhere(mask)]
    spans = R.pixels_to_spans(spark.createDataFrame(rows, "page_id long, y int, x int"), ["page_id"])
    size = spark.createDataFrame([(1, 30, 25)], "page_id long, width int, height int")
    got = {(r.y, r.x) for r in R.spans_to_pixels(R.close_mask(spans, kernel, size, iterations)).collect()}
    assert got == {(int(y), int(x)) for y, x in np.argwhere(dense_close(mask, kernel, iterations))}


def test_ellipse_kernel_shape():
    rows = R.ellipse_kernel(50, 50)
    assert len(rows) == 50 and rows[25][1:] == (-25, 24)
    assert all(lo <= 0 <= hi for _, lo, hi in rows)


def test_outline_of_known_shapes():
    def outline(mask):
        y, x0, x1 = images.runs(mask.astype(bool))
        return list(zip(*(v.tolist() for v in run_outlines(np.zeros(len(y)), y, x0, x1)[1:])))

    assert outline(np.ones((1, 1))) == [(0, 0)]
    assert outline(np.ones((4, 6))) == [(0, 0), (5, 0), (5, 3), (0, 3)]
    assert set(outline(np.ones((1, 5)))) == {(0, 0), (4, 0)}
    ring = np.ones((5, 5))
    ring[2, 2] = 0
    assert set(outline(ring)) == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_outline_fills_back_to_the_component(spark):
    rng = np.random.default_rng(5)
    blob = np.zeros((20, 20), bool)
    y, x = 10, 10
    for _ in range(160):
        blob[y, x] = True
        y, x = np.clip([y + rng.integers(-1, 2), x + rng.integers(-1, 2)], 0, 19)
    spans = R.pixels_to_spans(spark.createDataFrame([(1, int(a), int(b)) for a, b in np.argwhere(blob)], "page_id long, y int, x int"), ["page_id"])
    shape = C.outlines(C.components(spans))
    filled = {(r.y, r.x) for r in R.spans_to_pixels(R.fill_polygons(shape.select("page_id", "points"))).collect()}
    assert {(int(a), int(b)) for a, b in np.argwhere(blob)} <= filled
    ys, xs = zip(*filled)
    assert (min(ys), max(ys)) == (np.argwhere(blob)[:, 0].min(), np.argwhere(blob)[:, 0].max())


def test_cyclic_pairs(spark):
    lab = spark.createDataFrame([(f"l{i}",) for i in range(3)], "stem string")
    unl = spark.createDataFrame([(f"u{i}",) for i in range(7)], "stem string")
    got = [(r.labeled, r.unlabeled) for r in sel.cyclic_pairs(lab, unl).orderBy("i").collect()]
    assert got == [(f"l{i % 3}", f"u{i}") for i in range(7)]


def test_all_labeled_means_all_unlabeled(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "stem string")
    labeled, unlabeled = sel.split_labeled(pages, pages)
    assert labeled.count() == unlabeled.count() == 2


def test_batches_drop_the_incomplete_last(spark):
    items = spark.createDataFrame([(f"p{i}",) for i in range(10)], "stem string")
    assert sel.batch_plan(items, 4, 1, 1).count() == 8
    assert sel.batch_plan(items, 16, 1, 1).count() == 10


def test_memory_ring(spark):
    rows = [(0, i, [float(i)]) for i in range(11)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>")
    for upto, want in ((3, [0, 1, 2]), (5, [1, 2, 3, 4]), (11, [7, 8, 9, 10])):
        got = memory.last_per_class(df.filter(F.col("vec_id") < upto), 4)
        assert sorted(r.vec_id for r in got.collect()) == want


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(S.half_even(F.lit(1 / 32), 4).alias("r")).first().r == 0.0312


def test_fixed_format_matches_printf(spark):
    values = [0.0003125, 0.5, 1 / 3, 123.4567895, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(S.fixed(F.col("v")).alias("t")).collect()] == [f"{v:.6f}" for v in values]


def test_unknown_split_is_an_error(spark):
    good = spark.createDataFrame([("Training",), (None,)], "s string").select(S.canonical_split(F.col("s")).alias("c"))
    assert [r.c for r in good.collect()] == ["train", "test"]
    with pytest.raises(Exception, match="unsupported split"):
        spark.createDataFrame([("dev",)], "s string").select(S.canonical_split(F.col("s"))).collect()


def test_natural_key_orders_numbers(spark):
    names = ["p_10", "p_9", "p_0100", "p_2_b", "p_2_a10", "p_2_a9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(S.natural_key(F.col("n"))).collect()]
    assert got == ["p_2_a9", "p_2_a10", "p_2_b", "p_9", "p_10", "p_0100"]


def test_contains_join_with_several_lengths(spark):
    texts = ["x_ab_1", "zabz", "cab", "none", "a"]
    names = ["ab", "cab", "a", "zabzz"]
    f = spark.createDataFrame([(t,) for t in texts], "t string")
    n = spark.createDataFrame([(t,) for t in names], "n string")
    got = sorted((r.t, r.n) for r in contains_join(f, n, "t", "n").collect())
    assert got == sorted((t, m) for t in texts for m in names if m in t)


def test_mean_of_nothing_is_nan(spark):
    empty = spark.createDataFrame([], "image string, IoU double")
    assert np.isnan(metrics.mean_metrics(empty, ["IoU"]).first().IoU)


def test_perfect_detector_has_ap_one(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0)], "score double, tp int")
    row = metrics.average_precision(metrics.precision_recall(df, 2)).first()
    assert (row.ap, row.precision, row.recall) == (1.0, 1.0, 1.0)
