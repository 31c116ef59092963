"""Components one pixel wide are annotations too."""

from pyspark.sql import functions as F

from scriptoria.checks import raster
from scriptoria.checks.registry import QUERIES


def test_column_of_pixels_is_an_annotation(spark):
    # twelve text lines whose masks leave only the first column of pixels connected
    lines = spark.range(12).select(
        F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("line_idx"), F.lit(3).cast("long").alias("pk"),
        F.lit(1).cast("long").alias("sk"), F.lit(0.0).alias("tax"), F.lit(0.0).alias("discount"))

    class Lines(raster.Samples):
        line = lines

    found = QUERIES["k02_coco_from_mask"](Lines(spark, "")).collect()
    assert {(r.left, r.width, r.height, r.area) for r in found} == {(0, 1, 24, 24), (4, 4, 24, 96), (11, 4, 24, 96)}
