"""COCO instance annotations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators.scan import prefix_scan, row_numbers

SCHEMA = (
    "images array<struct<id:int,file_name:string,width:int,height:int>>,"
    "annotations array<struct<id:int,image_id:int,category_id:int,bbox:array<double>,"
    "segmentation:array<array<double>>,area:double,iscrowd:int>>,"
    "categories array<struct<id:int,name:string,supercategory:string>>"
)

# Fixed value: the only category.
CATEGORY = '{"id":1,"name":"TextLine","supercategory":"text"}'


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def images(documents: DataFrame) -> DataFrame:
    return documents.select("path", F.explode("images").alias("i")).select("path", "i.*")


def annotations(documents: DataFrame) -> DataFrame:
    return documents.select("path", F.explode("annotations").alias("a")).select("path", "a.*")


def number_images(pages: DataFrame, groups: list[str], order: list[Column], counts: str = "n_lines") -> DataFrame:
    """Add image_id from 1 per group in name order and first_ann, the id of the page's first annotation.

    *counts* holds the annotations of each page; annotation ids follow (image,
    document) order, so they are offsets of pages and need no sort of the lines.
    """
    scanned = prefix_scan(pages, groups, order, {"image_id": ("count", F.lit(1)), "_upto": ("sum", F.col(counts))})
    return scanned.withColumn("image_id", F.col("image_id").cast("int")).withColumn(
        "first_ann", F.col("_upto") - F.col(counts) + 1
    ).drop("_upto")


def annotate(lines: DataFrame, numbered_pages: DataFrame, keys: list[str]) -> DataFrame:
    """Annotation rows of lines (keys, line_idx, points) with their ids.

    Lines of a page are numbered from 0 without gaps in line_idx.
    """
    box = G.bounding_xywh(F.col("points"))
    rows = lines.join(numbered_pages, keys).withColumn("bbox", box)
    return rows.select(
        *numbered_pages.columns, "line_idx",
        (F.col("first_ann") + F.col("line_idx")).cast("long").alias("ann_id"),
        "bbox", F.array(G.flatten_points(F.col("points"))).alias("segmentation"),
        (F.col("bbox")[2] * F.col("bbox")[3]).alias("area"),
    )


def annotate_components(components: DataFrame, numbered_pages: DataFrame, keys: list[str], min_area: int = 50) -> DataFrame:
    """Annotation rows from mask components (keys, comp_idx, x, y, w, h, area, segmentation).

    Components under *min_area* pixels or without an outline of 3 points get no id.
    """
    kept = components.filter((F.col("area") >= min_area) & (F.size("segmentation") > 0))
    order = [F.col("image_id"), F.col("comp_idx")]
    groups = [c for c in ("manuscript", "split") if c in numbered_pages.columns]
    rows = row_numbers(kept.join(numbered_pages.drop("first_ann"), keys), groups, order, "ann_id")
    return rows.withColumn("bbox", F.array("x", "y", "w", "h")).drop("x", "y", "w", "h")


def _joined(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ","), F.lit("]"))


def image_json(image_id: Column, file_name: Column, width: Column, height: Column) -> Column:
    return F.to_json(F.struct(
        image_id.alias("id"), file_name.alias("file_name"), width.alias("width"), height.alias("height")
    ))


def annotation_json(ann_id: Column, image_id: Column, bbox: Column, segmentation: Column, area: Column) -> Column:
    return F.to_json(F.struct(
        ann_id.alias("id"), image_id.alias("image_id"), F.lit(1).alias("category_id"), bbox.alias("bbox"),
        segmentation.alias("segmentation"), area.alias("area"), F.lit(0).alias("iscrowd"),
    ))


def document_rows(image_rows: DataFrame, annotation_rows: DataFrame, groups: list[str]) -> DataFrame:
    """The documents as text rows (groups, part, seq, text); a group's rows in order are one JSON document.

    Ids count from 1 in each group, so every element but the first gets a leading comma.
    """
    def element(json: Column, seq: Column) -> Column:
        return F.concat(F.when(seq == 1, "").otherwise(","), json)

    image_text = element(image_json(F.col("image_id"), F.col("file_name"), F.col("width"), F.col("height")), F.col("image_id"))
    ann_text = element(
        annotation_json(F.col("ann_id"), F.col("image_id"), F.col("bbox"), F.col("segmentation"), F.col("area")), F.col("ann_id")
    )
    image_part = image_rows.select(*groups, F.lit(1).alias("part"), F.col("image_id").cast("long").alias("seq"), image_text.alias("text"))
    ann_part = annotation_rows.select(*groups, F.lit(3).alias("part"), F.col("ann_id").cast("long").alias("seq"), ann_text.alias("text"))
    fixed = F.explode(F.array(*[
        F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(text).alias("text"))
        for part, text in ((0, '{"images":['), (2, '],"annotations":['), (4, f'],"categories":[{CATEGORY}]}}'))
    ])).alias("f")
    frame = image_rows.select(*groups).distinct().select(*groups, fixed).select(*groups, "f.*")
    return frame.unionByName(image_part).unionByName(ann_part)


def write_documents(rows: DataFrame, path: str, groups: list[str], mode: str = "overwrite") -> None:
    """Write the document of each group as one valid JSON file, in a folder by *groups*.

    A document is one file, so one task writes it: its rows are sorted (on disk where
    needed) and streamed, never held.  Documents of different groups are written side by
    side.
    """
    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "part", "seq")
    # a session may cut files by row number; a document must not be cut
    ordered.select(*groups, "text").write.mode(mode).option("maxRecordsPerFile", 0).partitionBy(*groups).text(path)
