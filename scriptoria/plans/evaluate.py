"""From predictions to text lines, and from text lines to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators import components as C
from scriptoria.operators import lines as L
from scriptoria.operators import matching as M
from scriptoria.operators import metrics as Q
from scriptoria.operators import pages as P
from scriptoria.operators import spans as R
from scriptoria.operators.mask_pages import Masks
from scriptoria.operators.scan import row_numbers
from scriptoria.session import checkpointed


def lines_from_probabilities(
    pixels: DataFrame, size: DataFrame, threshold: float = 0.5, min_area: int = 200, ratio: float = 0.005
) -> DataFrame:
    """Text lines of probability maps: page_id, line_no, points, baseline.

    Pixels above the threshold are closed with a 7 x 3 rectangle; each component of
    at least *min_area* pixels gives a simplified outline and a baseline on its last row.
    """
    return _lines_of(R.pixels_to_spans(pixels.filter(F.col("prob") > threshold), ["page_id"]), size, min_area, ratio)


def lines_from_probability_rows(
    rows: DataFrame, size: DataFrame, threshold: float = 0.5, min_area: int = 200, ratio: float = 0.005
) -> DataFrame:
    """:func:`lines_from_probabilities` of pixel rows (page_id, y, array prob from x = 0); single pixels are not sorted."""
    return _lines_of(R.rows_to_spans(rows, ["page_id"], "prob", above=threshold), size, min_area, ratio)


def _lines_of(mask: DataFrame, size: DataFrame, min_area: int, ratio: float) -> DataFrame:
    labelled = C.components(R.close_mask(mask, R.rect_kernel(7, 3), size), size=size)
    # stored: numbering looks at the sizes of groups first, and what lies below is the whole job
    kept = checkpointed(C.outlined(labelled, min_area).filter(F.size("points") >= 3))
    numbered = row_numbers(kept, ["page_id"], [F.col("comp")], "line_no", start=0)
    base = G.baseline_from_box(F.col("left"), F.col("top"), F.col("width"), F.col("height"), "bottom")
    return numbered.select(
        "page_id", "line_no", G.format_points(G.simplify(F.col("points"), ratio)).alias("points"), G.format_points(base).alias("baseline")
    )


def lines_from_detections(polygons: DataFrame, region: DataFrame | None, ratio: float = 0.0025) -> DataFrame:
    """Detected polygons (page_id, det_idx, points, score) as text lines in reading order."""
    simple = polygons.withColumn("points", G.simplify(F.col("points"), ratio)).filter(F.size("points") >= 3)
    if region is not None:
        simple = L.inside_region(simple, region, L.polygon_centre())
    based = simple.withColumn("baseline", G.baseline_bottom_band(F.col("points"))).filter(F.size("baseline") >= 2)
    return L.reading_order(based, "page_id", "det_idx", "place").withColumn("line_no", F.col("place") - 1).drop("place")


def detected_boxes(boxes: DataFrame, region: DataFrame | None, min_score: float = 0.5) -> DataFrame:
    """Boxes to cut crops from: confident, inside the text region, no row twice."""
    kept = boxes.filter(F.col("score") >= min_score)
    if region is not None:
        kept = L.inside_region(kept, region, L.box_centre())
    return L.suppress_rows(kept)


def score_polygons(gt: DataFrame, pred: DataFrame, threshold: float = 0.75, digits: int = 4, size: DataFrame | None = None) -> DataFrame:
    """Page scores of polygon lines (page_id, gt_idx / pred_idx, points), pixel-exact.

    With *size* (page_id, width, height) only pixels on the page count; lines outside
    still count as lines.
    """
    return score_polygon_lines(P.side_by_side(gt, pred, "points"), threshold, digits, size)


def score_polygon_lines(lines: DataFrame, threshold: float = 0.75, digits: int = 4, size: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """:func:`score_polygons` of both sides in one table (page_id, truth, idx, points); *most* bounds the lines of a page on a side, where that is known."""
    return M.score_counts(P.Sides(lines, P.Polygons(size), most).totals(threshold), digits)


LEVELS = 10


def detection_scores(gt: DataFrame, pred: DataFrame, page_lines: int = M.PAGE_LINES) -> DataFrame:
    """map50, map50_95 and precision and recall at the best F1 of IoU 0.5, of boxes (page_id, gt_idx / pred_idx, x1, y1, x2, y2; score).

    Predictions of a page are matched in score order at IoU 0.50, 0.55, to 0.95.  Pages of at most
    *page_lines* lines on a side are matched in arrays, many pages together, and come back as counts of
    equal scores and hits; on larger ones pairs meet by cells, and a page at a level is a page of its own.
    """
    box = ["x1", "y1", "x2", "y2"]
    kind = dict(pred.dtypes)["score"]
    # stored: read for the sizes of pages and for the matching
    both = checkpointed(gt.select("page_id", F.lit(True).alias("truth"), F.col("gt_idx").cast("long").alias("idx"), *box, F.lit(None).cast(kind).alias("score")).unionByName(
        pred.select("page_id", F.lit(False).alias("truth"), F.col("pred_idx").cast("long").alias("idx"), *box, "score")))
    counts = checkpointed(both.groupBy("page_id").agg(F.count_if("truth").alias("N_gt"), F.count_if(~F.col("truth")).alias("N_pred")))
    large = counts.filter(F.greatest("N_gt", "N_pred") > page_lines).select("page_id")
    if large.isEmpty():
        parts = M.hits_of_pages(both, LEVELS)
    else:
        apart, rest = both.join(large, "page_id", "left_semi"), both.join(large, "page_id", "left_anti")
        lines = apart.filter("truth").select("page_id", F.col("idx").alias("gt_idx"), *box), apart.filter("not truth").select("page_id", F.col("idx").alias("pred_idx"), *box, "score")
        parts = M.hits_of_pages(rest, LEVELS).unionByName(_hits_by_pairs(*lines, counts))
    alike = parts.groupBy("score", "hits").agg(F.sum("times").alias("times"))
    told = alike.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    flagged = told.select("i", "score", F.getbit("hits", F.col("i")).cast("int").alias("tp"), "times")
    curve = Q.precision_recall(flagged, counts.agg(F.sum("N_gt")).first()[0] or 0, ["i"], times=F.col("times"))
    ap = Q.average_precision(curve, ["i"])
    first = lambda c: F.max(F.when(F.col("i") == 0, F.col(c)))
    return ap.agg(first("ap").alias("map50"), F.avg("ap").alias("map50_95"), first("precision").alias("precision"), first("recall").alias("recall"))


def _hits_by_pairs(gt: DataFrame, pred: DataFrame, counts: DataFrame) -> DataFrame:
    """What :func:`M.hits_of_pages` gives, for pages of any size."""
    order = [F.col("score").desc(), F.col("pred_idx")]
    ranked = checkpointed(row_numbers(pred, ["page_id"], order, "turn", start=0))
    overlaps = M.box_overlap(M.candidate_pairs(gt, ranked.drop("pred_idx").withColumnRenamed("turn", "pred_idx"), min_iou=0.5))
    levels = F.filter(F.array(*[F.lit(i) for i in range(LEVELS)]), lambda i: F.col("iou") >= (50 + 5 * i) / 100.0)
    exploded = overlaps.withColumn("i", F.explode(levels)).select(
        (F.col("page_id") * LEVELS + F.col("i")).alias("page_id"), F.col("pred_idx").alias("gt_idx"), F.col("gt_idx").alias("pred_idx"), "iou"
    )
    # sizes are looked up under the same page numbers as the pairs
    at_levels = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("page_id", F.col("page_id") * LEVELS + F.col("i"))
    wins = M.greedy_match(exploded, 0.5, at_levels)
    true_hits = wins.select(F.floor(F.col("page_id") / LEVELS).alias("page_id"), (F.col("page_id") % LEVELS).cast("int").alias("i"), F.col("gt_idx").alias("turn"))
    hits = true_hits.groupBy("page_id", "turn").agg(F.sum(F.expr("shiftleft(1, i)")).alias("hits"))
    marked = ranked.select("page_id", "turn", "score").join(hits, ["page_id", "turn"], "left")
    return marked.groupBy("score", F.coalesce("hits", F.lit(0).cast("long")).alias("hits")).agg(F.count(F.lit(1)).alias("times"))


def score_masks(gt_spans: DataFrame, pred_spans: DataFrame, threshold: float = 0.75, digits: int = 2) -> DataFrame:
    """Page scores of mask components (page_id, y, x0, x1)."""
    return M.page_scores(*M.component_matches(gt_spans, pred_spans, threshold), digits)


def score_mask_rows(rows: DataFrame, threshold: float = 0.75, digits: int = 2, most: int | None = None) -> DataFrame:
    """:func:`score_masks` of pixel rows (page_id, y, arrays of booleans gt and pred); *most* bounds the pixels of a page, where that is known."""
    return M.score_counts(Masks(rows, most).totals(threshold), digits)
