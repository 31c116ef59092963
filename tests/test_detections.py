"""Predictions matched in arrays, many pages together, give what pairs of boxes give."""

import random

from scriptoria.operators import matching as M
from scriptoria.plans import evaluate

GT, PRED = "page_id long, gt_idx int, x1 int, y1 int, x2 int, y2 int", "page_id long, pred_idx int, x1 int, y1 int, x2 int, y2 int, score double"


def crowded(spark):
    rng = random.Random(3)
    gt, pred = [], []
    for page in range(60):
        for i in range(rng.choice([0, 1, 3, 12, 40])):
            x, y = rng.randint(0, 30), rng.randint(0, 30)
            gt.append((page, i, x, y, x + rng.randint(5, 20), y + rng.randint(5, 20)))
            for _ in range(rng.randint(0, 3)):
                moved = [v + rng.randint(-2, 2) for v in gt[-1][2:]]
                pred.append((page, len(pred), *moved, rng.choice([0.1, 0.5, 0.5, 0.9, rng.random(), float("nan"), None])))
    pred += [(70, 0, 1, 1, 5, 5, 0.3), (71, 1, 9, 9, 2, 2, 0.3)]  # no line on the page; a box turned round
    gt.append((71, 0, 1, 1, 5, 5))
    return spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)


def test_hits_in_arrays_and_by_pairs(spark):
    gt, pred = crowded(spark)
    pred = pred.filter("pred_idx <> 1 or page_id <> 71")
    counts = M.line_counts(gt, pred)
    both = gt.selectExpr("page_id", "true as truth", "gt_idx as idx", "x1", "y1", "x2", "y2", "cast(null as double) as score").unionByName(
        pred.selectExpr("page_id", "false as truth", "pred_idx as idx", "x1", "y1", "x2", "y2", "score"))
    summed = lambda df: sorted(map(repr, df.groupBy("score", "hits").agg({"times": "sum"}).collect()))
    found = summed(M.hits_of_pages(both, 10))
    assert found == summed(evaluate._hits_by_pairs(gt, pred, counts)) and len(found) > 100


def test_small_pages_need_no_join_of_pairs(spark, monkeypatch):
    gt, pred = crowded(spark)
    pred = pred.filter("score >= 0").filter("not isnan(score)")
    mixed = evaluate.detection_scores(gt, pred, page_lines=20).collect()
    monkeypatch.setattr(M, "candidate_pairs", None)
    assert evaluate.detection_scores(gt, pred, page_lines=200).collect() == mixed
