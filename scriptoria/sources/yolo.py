"""YOLO label lines: ``class cx cy w h`` boxes and ``class x1 y1 x2 y2 ...`` polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.functions import scalars as S


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per label line: path, stem, line."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return rows.withColumn("stem", S.stem(F.col("path")))


def tokens(line: Column) -> Column:
    return G.split_spaces(line)


def label_kind(line: Column) -> Column:
    """polygon, box or other, by the number of tokens."""
    return G.bound(F.size(tokens(line)), lambda n: F.when(n > 5, "polygon").when(n == 5, "box").otherwise("other"))


def numbers(line: Column) -> Column:
    return G.bound(tokens(line), lambda t: F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda v: v.cast("double")))


def polygon_pixels(line: Column, width: Column, height: Column) -> Column:
    """Vertices in pixels of a polygon line; null for other lines."""
    return F.when(label_kind(line) == "polygon", G.unflatten_points(numbers(line), width, height))


def box_pixels(line: Column, width: Column, height: Column) -> Column:
    """Corners in pixels of a box line; null for other lines."""
    corners = lambda v: F.struct(*G.denormalised_box(*(F.get(v, F.lit(i)) for i in range(4)), width, height))
    return F.when(label_kind(line) == "box", G.bound(numbers(line), corners))


def box_label(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Box line with six decimals."""
    return F.concat_ws(" ", F.lit("0"), *[S.fixed(c) for c in G.normalised_box(x1, y1, x2, y2, width, height)])


def polygon_label(category: Column, flat: Column, width: Column, height: Column, digits: int = 6) -> Column:
    """Polygon line from a flat segmentation; class is category - 1."""
    scaled = F.transform(flat, lambda v, i: S.fixed(v / F.when(i % 2 == 0, width).otherwise(height), digits))
    return F.concat_ws(" ", (category - 1).cast("string"), F.array_join(scaled, " "))


def box_label_from_coco(category: Column, bbox: Column, width: Column, height: Column, digits: int = 6) -> Column:
    """Box line from ``[x, y, w, h]``; class is category - 1."""
    values = [(bbox[0] + bbox[2] / 2) / width, (bbox[1] + bbox[3] / 2) / height, bbox[2] / width, bbox[3] / height]
    return F.concat_ws(" ", (category - 1).cast("string"), *[S.fixed(v, digits) for v in values])


def labels_from_coco(images: DataFrame, annotations: DataFrame, use_segments: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Label lines of COCO annotations; crowd rows are dropped."""
    sized = images.select(*keys, F.col("id").alias("image_id"), "file_name", "width", "height")
    rows = annotations.filter("iscrowd = 0").join(sized, [*keys, "image_id"])
    if use_segments:
        line = polygon_label(F.col("category_id"), F.flatten("segmentation"), F.col("width"), F.col("height"))
    else:
        line = box_label_from_coco(F.col("category_id"), F.col("bbox"), F.col("width"), F.col("height"))
    return rows.select(*keys, S.stem(F.col("file_name")).alias("stem"), F.col("id").alias("ann_id"), line.alias("line"))


def write_labels(rows: DataFrame, path: str, order: list[str], mode: str = "overwrite") -> None:
    """Rows (split, stem, line, *order*) as text, one folder per split and page."""
    ordered = rows.repartition("split", "stem").sortWithinPartitions("split", "stem", *order)
    ordered.select("split", "stem", "line").write.mode(mode).partitionBy("split", "stem").text(path)
