"""File listings and corpus layouts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions import scalars as S

# Folders below a manuscript, by family and kind of file; {m} is the manuscript.
ROOTS = {
    "diva": {
        "img": ["img-{m}/img"],
        "gt": ["pixel-level-gt-{m}/pixel-level-gt"],
        "xml": ["PAGE-gt-{m}-TASK-2/TASK-2", "PAGE-gt-{m}/PAGE-gt"],
    },
    "u_diads": {"img": ["img-{m}"], "gt": ["text-line-gt-{m}"]},
}

# Names a split folder may have, preferred first.
SPLIT_ALIASES = {
    ("diva", "img"): {"train": ["training"], "val": ["validation"], "test": ["public-test"]},
    ("diva", "gt"): {"train": ["training"], "val": ["validation"], "test": ["public-test"]},
    ("diva", "xml"): {"train": ["training"], "val": ["validation"], "test": ["public-test"]},
    ("u_diads", "img"): {"train": ["train", "training"], "val": ["val", "validation"], "test": ["test", "public-test"]},
    ("u_diads", "gt"): {"train": ["train", "training"], "val": ["val", "validation"], "test": ["test", "public-test"]},
    ("u_diads_coco", "img"): {"train": ["train", "training"], "val": ["val", "validation"], "test": ["test"]},
    ("u_diads_coco", "gt"): {"train": ["training", "train"], "val": ["validation", "val"], "test": ["test"]},
}


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length and modificationTime of the files below *root*; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime")


def list_images(
    files: DataFrame, extensions: Sequence[str] = S.IMAGE_EXTENSIONS, ignore_case: bool = True
) -> DataFrame:
    """Rows of *files* (path) with an image extension, with name, stem and ext, sorted by name."""
    path = F.col("path")
    hits = files.filter(S.has_extension(path, extensions, ignore_case))
    return hits.select(
        "*", S.basename(path).alias("name"), S.stem(path).alias("stem_name"), S.extension(path).alias("extension")
    ).orderBy("name", "path")


def one_image_per_stem(images: DataFrame, keys: Sequence[str] = ("stem",)) -> DataFrame:
    """The path with the preferred extension for every stem."""
    rank = S.extension_priority(F.col("path"))
    return images.filter(rank.isNotNull()).groupBy(*keys).agg(F.min(F.struct(rank, "path")).getField("path").alias("path"))


def alias_table(spark: SparkSession, family: str) -> DataFrame:
    """kind, split, folder, priority of one family; as many rows as the fixed table above."""
    rows = [
        (kind, split, folder, rank)
        for (name, kind), splits in SPLIT_ALIASES.items()
        if name == family
        for split, folders in splits.items()
        for rank, folder in enumerate(folders)
    ]
    if not rows:
        raise ValueError(f"unsupported family: {family}")
    return spark.createDataFrame(rows, "kind string, split string, folder string, priority int")


def resolve_splits(files: DataFrame, aliases: DataFrame, keys: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """The first existing folder for each (kind, split).

    *files* has kind, folder and any further *keys* (a manuscript).  A missing
    folder of a kind in *required* raises an error.
    """
    existing = files.groupBy(*keys, "kind", "folder").agg(F.count(F.lit(1)).alias("n_files"))
    ranked = existing.join(F.broadcast(aliases), ["kind", "folder"])
    found = ranked.groupBy(*keys, "kind", "split").agg(
        F.min(F.struct("priority", "folder", "n_files")).alias("best")
    ).select(*keys, "kind", "split", "best.folder", "best.n_files")
    if not required:
        return found
    wanted = aliases.filter(F.col("kind").isin(list(required))).select("kind", "split").distinct()
    groups = files.select(*keys).distinct() if keys else files.sparkSession.range(1).select()
    complete = groups.join(F.broadcast(wanted)) if keys else wanted
    missing = F.raise_error(F.concat_ws(" ", F.lit("no folder for"), "kind", "split")).cast("string")
    return complete.join(found, [*keys, "kind", "split"], "full").withColumn("folder", F.coalesce("folder", missing))


def parse_layout(files: DataFrame, family: str) -> DataFrame:
    """manuscript, kind, folder, stem and ext of every path that fits a family's layout.

    Of several roots a kind may have, the first that exists in a manuscript counts.
    """
    if family not in ROOTS:
        raise ValueError(f"unsupported family: {family}")
    path = F.col("path")
    shapes = []
    for kind, roots in ROOTS[family].items():
        for rank, root in enumerate(roots):
            pattern = r"([^/]+)/" + root.replace("{m}", r"\1") + r"/([^/]+)/[^/]+$"
            shapes.append(F.when(
                path.rlike(pattern),
                F.struct(
                    F.lit(kind).alias("kind"), F.lit(rank).alias("root_rank"),
                    F.regexp_extract(path, pattern, 1).alias("manuscript"),
                    F.regexp_extract(path, pattern, 2).alias("folder"),
                ),
            ))
    fits = files.select("path", F.coalesce(*shapes).alias("shape")).filter("shape is not null")
    parsed = fits.select("path", "shape.*", S.stem(path).alias("stem"), S.extension(path).alias("ext"))
    best = parsed.groupBy("manuscript", "kind").agg(F.min("root_rank").alias("root_rank"))
    return parsed.join(best, ["manuscript", "kind", "root_rank"]).drop("root_rank")


def manifest(files: DataFrame, family: str, required: Sequence[str] = ("img", "gt")) -> DataFrame:
    """One row per page: manuscript, split, stem and the paths of its image, mask and XML."""
    parsed = parse_layout(files, family)
    chosen = resolve_splits(parsed, alias_table(files.sparkSession, family), ["manuscript"], required)
    members = parsed.join(chosen.select("manuscript", "kind", "split", "folder"), ["manuscript", "kind", "folder"])
    rank = S.extension_priority(F.col("path"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct(rank, "path"))).getField("path")
    pages = members.groupBy("manuscript", "split", "stem").agg(
        of("img").alias("path"), of("gt").alias("gt_path"), of("xml").alias("xml_path")
    )
    return pages.filter("path is not null").withColumn("family", F.lit(family))


def with_on_missing(df: DataFrame, column: str, on_missing: str, what: str = "file") -> DataFrame:
    """Apply one of the policies skip, error or keep to rows where *column* is null."""
    if on_missing == "skip":
        return df.filter(F.col(column).isNotNull())
    if on_missing == "keep":
        return df
    if on_missing == "error":
        return df.withColumn(column, F.coalesce(F.col(column), F.raise_error(F.lit(f"missing {what}")).cast(df.schema[column].dataType)))
    raise ValueError(f"unknown policy: {on_missing}")


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded images: path, height, width, n_channels, data (rows of B, G, R bytes)."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(paths).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"),
    )


def image_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Width and height of image files."""
    return read_images(spark, paths).select("path", "width", "height")


# Paths that one read opens: a bound of the driver's memory and of a broadcast.
PATHS_AT_ONCE = 10_000


def bytes_of_paths(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """*rows* (path and other columns, at most PATHS_AT_ONCE) with the content of their files, no other of which is opened."""
    if len(rows) > PATHS_AT_ONCE:
        raise ValueError(f"more than {PATHS_AT_ONCE} paths at once")
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in rows]  # names, not patterns
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.join(F.broadcast(spark.createDataFrame(rows, schema)), "path")


def copy_new_images(spark: SparkSession, sources: DataFrame, target: str, roots: str | list[str] | None = None, existing: DataFrame | None = None) -> None:
    """Store image bytes by split, leaving out what *existing* (split, name) already holds.

    *sources* has path and split.  The new paths pass through the driver in parts, as a listing
    of files does; tasks open these files only, however many others their folders hold, and
    write their bytes where they read them.  Bytes go to parquet partitioned by split.  *roots*
    is not needed any more.
    """
    wanted = sources.select("path", "split", S.basename(F.col("path")).alias("name"))
    if existing is not None:
        wanted = wanted.join(existing.select("split", "name"), ["split", "name"], "left_anti")
    wanted = wanted.select("path", "split", "name")
    new = wanted.toLocalIterator()
    while rows := list(islice(new, PATHS_AT_ONCE)):
        bytes_of_paths(spark, rows, wanted.schema).write.mode("append").partitionBy("split").parquet(target)
