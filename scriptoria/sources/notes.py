"""Selection notes: text files listing chosen pages under method headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import scalars as S
from scriptoria.operators.scan import prefix_scan, top_per_group

# Heading of each method's block.
HEADINGS = {
    "grayscale_variance": "Grayscale variance method",
    "pca_max_distance": "PCA max distance method",
    "pca_centroid": "PCA centroid method",
    "ica_max_distance": "ICA max distance method",
    "ica_centroid": "ICA centroid method",
}

# Fixed value: how a page is listed.
ENTRY = r"Image\s+\d+:\s+(\S+\.jpg)"


def read_notes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_id, n (line number), line of text files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("file_id"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")
    )


def listed_pages(notes: DataFrame, method: str = "grayscale_variance", k: int = 1) -> DataFrame:
    """First *k* stems of the method's block in every file: file_id, rank, stem.

    A heading opens the block.  Any other line that is neither blank nor indented
    closes it.
    """
    heading = HEADINGS.get(method, method)
    line = F.regexp_replace("line", r"\s+$", "")
    rows = notes.select("file_id", "n", line.alias("line"))
    opens = F.col("line").contains(heading)
    closes = (F.col("line") != "") & ~F.col("line").startswith(" ")
    event = F.when(opens, 1).when(closes, 0)
    scanned = prefix_scan(rows.withColumn("event", event), ["file_id"], [F.col("n")], {"inside": ("last", F.col("event"))})
    name = F.regexp_extract("line", ENTRY, 1)
    hits = scanned.filter(F.col("event").isNull() & (F.col("inside") == 1) & (name != ""))
    stems = hits.select("file_id", "n", S.stem(name).alias("stem"))
    return top_per_group(stems, ["file_id"], [F.col("n")], k).select("file_id", "rank", "stem")


def pages_of_file(spark: SparkSession, path: str, method: str = "grayscale_variance", k: int = 1) -> DataFrame:
    """Stems of one notes file; an error if it lists none for the method."""
    found = listed_pages(read_notes(spark, path), method, k)
    if found.isEmpty():
        raise ValueError(f"no entries for method {method!r} in {path}; known headings: {list(HEADINGS.values())}")
    return found.select("rank", "stem")
