"""Overlap of instances cut into pieces against counting pixels."""

import numpy as np
from pyspark.sql import functions as F

from scriptoria.operators import matching as M
from scriptoria.operators import spans as R


def painted(boxes):
    return {i: {(y, x) for y in range(y1, y2 + 1) for x in range(x1, x2 + 1)} for i, x1, y1, x2, y2 in boxes}


def test_pieces_equal_pixels(spark):
    rng = np.random.default_rng(4)
    sides = []
    for _ in range(2):
        corners = [(i, int(x), int(y), int(x + w), int(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(0, [60, 60, 9, 25], (30, 4)))]
        sides.append(corners)
    want = {}
    gt, pred = map(painted, sides)
    for g, a in gt.items():
        for p, b in pred.items():
            if a & b:
                want[g, p] = (len(a & b), len(a | b))
    frames = [spark.createDataFrame([(1, *r) for r in side], f"page_id long, {idx} int, x1 int, y1 int, x2 int, y2 int") for side, idx in zip(sides, ("gt_idx", "pred_idx"))]
    boxes = [M.box_pieces(d, idx, 4) for d, idx in zip(frames, ("gt_idx", "pred_idx"))]
    spans = [M.span_pieces(R.box_spans(d, ["page_id", idx]), idx, 4) for d, idx in zip(frames, ("gt_idx", "pred_idx"))]
    for a, b in (boxes, spans, (boxes[0], spans[1])):
        assert {(r.gt_idx, r.pred_idx): (r.inter, r.union) for r in M.piece_overlap(a, b).collect()} == want
    strong = {(r.gt_idx, r.pred_idx) for r in M.piece_overlap(*boxes, min_iou=0.2).collect()}
    assert strong == {k for k, (i, u) in want.items() if i / u >= 0.2}


def test_boxes_have_a_row_a_piece(spark):
    box = spark.createDataFrame([(1, 0, 3, 0, 9, 999)], "page_id long, gt_idx int, x1 int, y1 int, x2 int, y2 int")
    pieces = M.box_pieces(box, "gt_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.sum(F.size("run_y")).alias("runs")).first()
    assert (pieces["n"], pieces["area"], pieces["runs"]) == (4, 7000, 1000)
