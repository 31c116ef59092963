"""Annotation conversion: PAGE-XML to COCO and YOLO, masks to COCO."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators import components as C
from scriptoria.operators import lines as L
from scriptoria.sources import coco, page_xml, yolo


def pages_to_coco(pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows for pages that have a document.

    *pages* has manuscript, split, stem, file_name, width, height; *documents* comes
    from ``page_xml.read_pages``.
    """
    lines = page_xml.text_lines(documents, "all_lines")
    found = pages.join(documents.select("stem"), "stem", "left_semi")
    counts = L.lines_per_page(found, lines, "stem")
    numbered = coco.number_images(found.join(counts, "stem"), ["manuscript", "split"], [F.col("file_name")])
    return numbered, coco.annotate(lines, numbered, ["stem"])


def pages_to_yolo(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Box label rows: split, stem, line_idx, line."""
    lines = page_xml.text_lines(documents, "decimal").withColumn("b", G.bounding_box(F.col("points")))
    rows = lines.join(pages.select("split", "stem", "width", "height"), "stem")
    label = yolo.box_label(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), F.col("width"), F.col("height"))
    return rows.select("split", "stem", "line_idx", label.alias("line"))


def masks_to_coco(pages: DataFrame, spans: DataFrame, min_area: int = 50) -> tuple[DataFrame, DataFrame]:
    """Image and annotation rows from binary masks: one annotation per component.

    *pages* has page_id, manuscript, split, file_name, width, height.
    """
    labelled = C.components(spans)
    stats = C.component_stats(labelled).filter(F.col("area") >= min_area)
    shapes = C.outlines(labelled.join(stats.select("page_id", "comp"), ["page_id", "comp"], "left_semi"))
    flat = F.transform(G.flatten_points(F.col("points")), lambda v: v.cast("double"))
    shapes = shapes.filter(F.size("points") >= 3).select("page_id", "comp", F.array(flat).alias("segmentation"))
    found = stats.join(shapes, ["page_id", "comp"]).select(
        "page_id", F.col("comp").alias("comp_idx"), F.col("left").alias("x"), F.col("top").alias("y"),
        F.col("width").alias("w"), F.col("height").alias("h"), F.col("area").cast("double").alias("area"), "segmentation",
    )
    counts = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))
    sized = pages.join(counts, "page_id", "left").fillna(0, ["n_lines"])
    numbered = coco.number_images(sized, ["manuscript", "split"], [F.col("file_name")])
    return numbered, coco.annotate_components(found, numbered, ["page_id"], min_area)
