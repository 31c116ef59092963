"""Lines of both sides compared page by page, and what the queries on them move."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scriptoria import samples
from scriptoria.operators import matching as M
from scriptoria.operators import pages as P
from tests.test_less_moved import FOLDER, plan_of


def exchanges(spark, name):
    plan = plan_of(E.queries()[name](spark, FOLDER))
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


@pytest.mark.parametrize("name", ["a01_page_score", "j07_greedy_match", "j06_span_iou", "a01_polygon_page_score"])
def test_lines_move_once(spark, name):
    assert exchanges(spark, name) == (1, 0)


def boxes(spark, seed=7, pages=16):
    rng = random.Random(seed)
    rows = []
    for page in range(pages):
        for truth in (True, False):
            for idx in range(rng.choice([0, 1, 3, 9])):
                x, y = rng.randrange(6), rng.randrange(6)
                rows.append((page, truth, idx * 2, x, y, x + rng.randrange(5), y + rng.randrange(5)))
        rows.append((page, False, 99, None, 0, 3, 3))
    # boxes without pixels, and a page that is null: its lines count and meet nothing
    rows += [(0, True, 50, 4, 0, 1, 3), (1, False, 51, 0, 4, 3, 1), (None, True, 0, 0, 0, 3, 3), (None, False, 0, 0, 0, 3, 3)]
    return spark.createDataFrame(rows, "page_id long, truth boolean, idx int, x1 int, y1 int, x2 int, y2 int")


def apart(lines):
    return (lines.filter(F.col("truth") == t).drop("truth").withColumnRenamed("idx", n) for t, n in ((True, "gt_idx"), (False, "pred_idx")))


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("threshold", [0.3])
def test_pages_are_matched_as_by_cells(spark, threshold):
    lines = boxes(spark)
    gt, pred = apart(lines)
    want = M.greedy_match(M.box_overlap(M.candidate_pairs(gt, pred)), threshold)
    counts = M.line_counts(gt, pred)
    for known in (P.Sides(lines, P.Boxes(), 100), P.Sides(lines, P.Boxes()), P.Sides(lines, P.Boxes(), page_lines=4)):
        assert found(known.matches(threshold)) == found(want)
        assert found(known.totals(threshold)) == found(M.page_totals(counts, want))
    assert want.count() > 3 and P.Sides(lines, P.Boxes(), page_lines=4).large is not None


def test_many_steps(spark, monkeypatch):
    lines = boxes(spark)
    want = found(P.Sides(lines, P.Boxes(), 100).matches(0.2))
    monkeypatch.setattr(P, "STEP_PAIRS", 7)
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 3)
    batch = P.Sides(lines, P.Boxes(), 100).pages().toArrow().to_batches()[0]
    page, i, j, iou = P.Met(batch, P.Boxes(), []).matched(0.2)
    assert len(page) == len(want) and sorted(iou.tolist()) == sorted(w[3] for w in want)


def test_no_lines(spark):
    none = boxes(spark).limit(0)
    for most in (None, 5):
        sides = P.Sides(none, P.Boxes(), most)
        assert sides.totals().isEmpty() and sides.matches().isEmpty() and sides.overlaps().isEmpty()


def test_sides_are_line_and_pred(spark, monkeypatch):
    s = samples.Samples(spark, FOLDER)
    want = found(P.side_by_side(s.line.withColumnRenamed("line_idx", "gt_idx"), s.pred, "x1", "y1", "x2", "y2"))
    assert found(s.sides) == want
    monkeypatch.setattr(samples, "GROUP_LIMIT", 3)  # predictions are counted for themselves
    assert found(samples.Samples(spark, FOLDER).sides) == want


@pytest.mark.parametrize("name, shuffles, joins", [("a02_corpus_score", 2, 2), ("a03_subset_summary", 3, 2)])
def test_scores_are_joined_not_lines(spark, name, shuffles, joins):
    found = exchanges(spark, name)
    assert found[0] <= shuffles and found[1] <= joins
    df = E.queries()[name](spark, FOLDER)
    # no line is written to be read again
    assert "ExistingRDD" not in plan_of(df)


def test_runs_overlap_as_pieces(spark):
    lines = boxes(spark).filter("x1 is not null")
    gt, pred = apart(lines)
    want = found(M.piece_overlap(M.box_pieces(gt, "gt_idx"), M.box_pieces(pred, "pred_idx")))
    assert len(want) > 10 and found(P.Sides(lines, P.Runs(), 100).overlaps()) == want == found(P.Sides(lines, P.Runs(), page_lines=4).overlaps())


def test_polygons_overlap_as_pairs(spark):
    rng = random.Random(3)
    corner = lambda: (rng.randrange(-3, 14), rng.randrange(-3, 14))
    rows = [(page, truth, i, [corner() for _ in range(rng.choice([0, 1, 2, 3, 5]))]) for page in range(12) for truth in (True, False) for i in range(6)]
    rows += [(3, True, 60, None), (None, True, 0, [(0, 0), (4, 0), (4, 4)]), (None, False, 0, [(0, 0), (4, 0), (4, 4)])]
    lines = spark.createDataFrame(rows, "page_id long, truth boolean, idx int, points array<struct<x:int,y:int>>")
    size = spark.createDataFrame([(p, 9, 7) for p in range(10)] + [(10, 0, 5)], "page_id long, width int, height int")
    for pages in (None, size):
        want = found(M.polygon_overlap(*apart(lines), pages))
        assert len(want) > 10 and found(P.Sides(lines, P.Polygons(pages), 100).overlaps()) == want == found(P.Sides(lines, P.Polygons(pages), page_lines=4).overlaps())
