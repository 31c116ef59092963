"""From detections and images to documents, and from images to blended probabilities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions import geometry as G
from scriptoria.operators import cuts, matching, metrics, tiles
from scriptoria.operators.scan import row_numbers, spread
from scriptoria.operators.scoring import score_batches
from scriptoria.operators.spans import pixels_to_spans
from scriptoria.plans import evaluate
from scriptoria.session import checkpointed
from scriptoria.sources import images as images_of_masks
from scriptoria.sources import page_xml, tables


def blended_rows(
    images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 448, stride: int | None = None, batch_size: int = 16
) -> DataFrame:
    """Probabilities of every pixel row (page_id, y, array prob from x = 0): a model over overlapping windows, blended.

    *images* has page_id, height, width, n_channels, data.  The model takes windows as
    n x (size * size * 3) floats in 0 to 1, zeros beyond the page, and gives n x (size * size)
    numbers.
    """
    return tiles.blend_images(images, make_model, size, stride or size // 2, batch_size)


def blended_probabilities(
    images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int = 448, stride: int | None = None, batch_size: int = 16
) -> DataFrame:
    """:func:`blended_rows` as pixels (page_id, y, x, prob)."""
    rows = blended_rows(images, make_model, size, stride, batch_size)
    return rows.select("page_id", "y", F.posexplode("prob").alias("x", "prob"))


METRICS = ("IoU", "Precision", "Recall", "F1", "Dice")


def rated_masks(probs: DataFrame, masks: DataFrame, threshold: float = 0.5, policy: str = "any_channel") -> DataFrame:
    """METRICS of each page of *probs* (page_id, y, x, prob) against mask images (page_id, height, width, n_channels, data); pages without a mask have no row."""
    at = F.struct("x", F.col("prob"))
    rows = probs.groupBy("page_id", "y").agg(F.array_sort(F.collect_list(at)).alias("_at"))
    return rated_rows(rows.select("page_id", "y", F.transform("_at", lambda v: v["prob"]).alias("prob"), F.transform("_at", lambda v: v["x"]).alias("x")), masks, threshold, policy)


def rated_rows(rows: DataFrame, masks: DataFrame, threshold: float = 0.5, policy: str = "any_channel") -> DataFrame:
    """:func:`rated_masks` of pixel rows (page_id, y, array prob, from x = 0 or with an array x of places).

    Runs of text meet rows of probabilities, never single pixels.
    """
    truth = images_of_masks.mask_spans(masks.select(F.col("page_id").cast("string").alias("path"), "height", "width", "n_channels", "data"), policy)
    text = truth.filter("kind = 'text'").select(F.col("path").cast("long").alias("page_id"), "y", F.struct("x0", "x1").alias("_run"))
    runs = text.groupBy("page_id", "y").agg(F.collect_list("_run").alias("_runs"))
    known = rows.join(masks.select("page_id"), "page_id", "left_semi").join(runs, ["page_id", "y"], "left")
    place = (lambda i: F.get("x", i)) if "x" in rows.columns else (lambda i: i)
    none = F.array().cast(runs.schema["_runs"].dataType)
    truth_at = lambda i: F.exists(F.coalesce("_runs", none), lambda r: place(i).between(r["x0"], r["x1"]))
    cases = F.transform("prob", lambda p, i: F.when(p > threshold, F.when(truth_at(i), 3).otherwise(2)).otherwise(F.when(truth_at(i), 1).otherwise(0)))
    counted = known.select("page_id", cases.alias("_case"))
    count = lambda k: F.sum(F.size(F.filter("_case", lambda c: c == k)).cast("long"))
    return metrics.metrics_of_counts(counted.groupBy("page_id").agg(count(3).alias("tp"), count(2).alias("fp"), count(1).alias("fn")), ["page_id"])


def evaluate_masks(images: DataFrame, masks: DataFrame, make_model, path: str, size: int = 448, stride: int | None = None, threshold: float = 0.5,
                   policy: str = "any_channel", batch_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """Probabilities, masks and metrics of images (page_id, name, height, width, n_channels, data), written below *path*.

    Folders: ``prob_maps`` (pixels), ``pred_masks`` (spans), ``mask_metrics`` and
    ``mask_metrics_summary`` (CSV).  Returns the metrics by image and their means.
    """
    blended_probabilities(images, make_model, size, stride, batch_size).write.mode("overwrite").parquet(f"{path}/prob_maps")
    probs = images.sparkSession.read.parquet(f"{path}/prob_maps")
    pixels_to_spans(probs.filter(F.col("prob") > threshold), ["page_id"]).write.mode("overwrite").parquet(f"{path}/pred_masks")
    rated = checkpointed(rated_masks(probs, masks, threshold, policy).join(images.select("page_id", F.col("name").alias("image")), "page_id").select("image", *METRICS))
    mean = metrics.mean_metrics(rated, METRICS)
    if tables.write_metrics(rated.orderBy("image"), f"{path}/mask_metrics"):
        tables.write_metrics(mean, f"{path}/mask_metrics_summary")
    return rated, mean


def lines_from_boxes(
    images: DataFrame, boxes: DataFrame, region: DataFrame | None, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], min_score: float = 0.5
) -> DataFrame:
    """Text lines of detected boxes (page_id, pred_idx, x1, y1, x2, y2, score): page_id, line_no, points, baseline.

    Confident boxes inside the region, no row twice, are numbered from 0 in their order.  A model
    masks each box's pixels; its largest component gives the outline and the baseline.  Boxes
    without a usable mask, outline or baseline are left out and leave a gap in the numbers.
    """
    kept = row_numbers(evaluate.detected_boxes(boxes, region, min_score), ["page_id"], [F.col("y1"), F.col("pred_idx")], "line_no", start=0)
    sides = {"x0": "x1", "y0": "y1", "x1": "x2", "y1": "y2"}
    rects = kept.select("page_id", "line_no", *(F.col(b).cast("int").alias(a) for a, b in sides.items()))
    found = cuts.segment(images, rects, make_model).filter(F.size("points") >= 3)
    based = found.withColumn("baseline", G.baseline_bottom_band(F.col("points"))).filter(F.size("baseline") >= 2)
    return based.select("page_id", "line_no", "points", "baseline")


def document_rows(pages: DataFrame, lines: DataFrame, profile: str, **head: str) -> DataFrame:
    """Documents of lines (page_id, line_no, points, baseline as vertices) for all *pages* (page_id, stem, file_name, width, height)."""
    named = lines.join(pages.select("page_id", "stem"), "page_id").select(
        "stem", "line_no", G.format_points(F.col("points")).alias("points"), G.format_points(F.col("baseline")).alias("baseline"))
    return page_xml.document_rows(pages.select("stem", "file_name", "width", "height"), named, profile, **head)


def export_boxes(pages: DataFrame, images: DataFrame, boxes: DataFrame, region: DataFrame | None, make_model, path: str, profile: str = "detector", **head: str) -> None:
    """Write a document for every page, with the lines of its detected boxes."""
    page_xml.write_documents(document_rows(pages, lines_from_boxes(images, boxes, region, make_model), profile, **head), path)


def export_polygons(pages: DataFrame, polygons: DataFrame, region: DataFrame | None, path: str, profile: str = "detector", **head: str) -> None:
    """Write a document for every page, with its detected polygons (page_id, det_idx, points, score) in reading order."""
    page_xml.write_documents(document_rows(pages, evaluate.lines_from_detections(polygons, region), profile, **head), path)


def score_files(gt: DataFrame, pred: DataFrame, images: DataFrame | None = None, threshold: float = 0.75, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Page scores of documents read by ``read_pages``, and their mean: of stems with both documents (and an image, if given).

    Page scores have stem, N_gt, N_pred, M, DR, RA, FM; the mean has pages, mean_DR, mean_RA,
    mean_FM, and no row if no page is left.
    """
    both = gt.select("stem", "width", "height").join(pred.select("stem"), "stem", "left_semi")
    if images is not None:
        both = both.join(images.select("stem"), "stem", "left_semi")
    # pages get numbers: the operators tell pages by them
    numbered = checkpointed(row_numbers(both.dropDuplicates(["stem"]), [], [F.col("stem")], "page_id", start=0))

    def lines(docs: DataFrame, idx: str) -> DataFrame:
        return page_xml.text_lines(docs).join(numbered.select("stem", "page_id"), "stem").select("page_id", F.col("line_idx").alias(idx), "points")

    g, p = (checkpointed(spread(lines(docs, idx), "page_id")) for docs, idx in ((gt, "gt_idx"), (pred, "pred_idx")))
    scores = evaluate.score_polygons(g, p, threshold, digits, numbered)
    pages = numbered.select("page_id", "stem").join(scores, "page_id", "left").fillna(0).drop("page_id")
    pages = checkpointed(pages)
    return pages, matching.corpus_score(pages)
