"""Metric and box tables as CSV, data set descriptors, rebuild policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.functions import scalars as S
from scriptoria.operators.scan import row_numbers


def _first_lines(spark: SparkSession, path: str | list[str]) -> list[tuple[str, list[str], bool]]:
    """Path, names of the columns, and whether a quoted cell holds a line end, of each file with a header.

    One row a file comes to the driver, like Spark's own listing of the files.
    """
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("at"))
    open_quote = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    files = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"), F.max(open_quote).alias("multi"))
    width = files.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    cells = F.from_csv("header", F.lit(", ".join(f"c{i} string" for i in range(width))))
    named = files.select("path", F.transform(F.array(*(cells[f"c{i}"] for i in range(width))), F.trim).alias("names"), "multi")
    return sorted((r.path, r.names, r.multi) for r in named.collect() if any(r.names))


def read_metrics(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """Numeric columns of the CSV files of folders, with a header each; what cannot be read becomes null.

    Files may differ in their columns: those with equal headers are read together, by Spark's CSV
    reader.  A file is split over tasks unless a quoted cell holds a line end.  Columns: path,
    row_no (from 0 in the file), *columns*.
    """
    groups: dict[tuple, list[str]] = {}
    for file, names, multi in _first_lines(spark, path):
        groups.setdefault((tuple(names), multi), []).append(file)
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("_at", T.StructType([T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]))])
    for c in columns:
        schema = schema.add(c, T.DoubleType())
    rows = spark.createDataFrame([], schema)
    for (names, multi), files in groups.items():
        width = next(i for i in range(len(names), 0, -1) if names[i - 1])
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        options = {"header": True, "multiLine": multi, "ignoreCorruptFiles": True, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
        read = spark.read.options(**options).schema(fields).csv(files)
        cells = [F.col(f"c{names.index(c)}").try_cast("double") if c in names else F.lit(None).cast("double") for c in columns]
        at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
        rows = rows.unionAll(read.select(F.col("_metadata.file_path").alias("path"), at.alias("_at"), *(v.alias(c) for v, c in zip(cells, columns, strict=True))))
    return row_numbers(rows, ["path"], [F.col("_at")], "row_no", start=0).select("path", "row_no", *columns)


def mean_of_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of the readable values; NaN where there are none."""
    return rows.agg(*[F.coalesce(F.avg(F.col(c).try_cast("double")), F.lit(float("nan"))).alias(c) for c in columns])


def write_metrics(rows: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """CSV with header; nothing is written for no rows.  True if written."""
    if rows.isEmpty():
        return False
    rows.write.mode(mode).option("header", True).csv(path)
    return True


def box_rows(pages: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """image_filename, textline_id, x, y, width, height, area of the lines; pages without lines have no rows."""
    joined = lines.join(pages.select(*keys, "stem", "file_name"), list(keys))
    return joined.select(
        "stem", F.col("file_name").alias("image_filename"),
        F.format_string("textline_%d", F.col("line_idx")).alias("textline_id"),
        F.col("x").alias("x"), F.col("y").alias("y"), F.col("w").alias("width"), F.col("h").alias("height"),
        F.col("area").cast("double").alias("area"), "line_idx",
    )


def write_boxes(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Box rows as CSV, one folder per page."""
    ordered = rows.repartition("stem").sortWithinPartitions("stem", "line_idx").drop("line_idx")
    ordered.write.mode(mode).option("header", True).partitionBy("stem").csv(path)


def dataset_descriptor(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "val", "test"), names: Sequence[str] = ("textline",)) -> DataFrame:
    """Where each split's images are and what the classes are called."""
    rows = [(root, split, f"images/{split}", dict(enumerate(names))) for split in splits]
    return spark.createDataFrame(rows, "path string, split string, images string, names map<int,string>")


def write_with_policy(df: DataFrame, path: str, policy: str = "reuse", partition_by: Sequence[str] = ()) -> None:
    """reuse keeps existing output, rebuild replaces it, refresh replaces only the partitions *df* holds."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if policy == "reuse":
        writer.mode("ignore").parquet(path)
    elif policy == "rebuild":
        writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    elif policy == "refresh":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        raise ValueError(f"unknown policy: {policy}")


def write_masks(spans: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predicted masks as a span table."""
    spans.write.mode(mode).parquet(path)


def probability_level(prob: Column) -> Column:
    """``clip(prob * 255)`` cut to a whole number."""
    return F.floor(F.least(F.greatest(prob * 255, F.lit(0.0)), F.lit(255.0))).cast("short")


def write_probabilities(pixels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Probability maps as bytes."""
    pixels.withColumn("level", probability_level(F.col("prob"))).drop("prob").write.mode(mode).parquet(path)


def output_stems(files: DataFrame) -> DataFrame:
    """Stems that already have an output file."""
    return files.select(S.stem(F.col("path")).alias("stem")).distinct()
