"""Choosing pages for few labels, pairing them, planning batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import scalars as S
from scriptoria.operators.scan import row_numbers, top_per_group
from scriptoria.sources import notes

# A labeled set up to this size is sent to every task.
BROADCAST_ROWS = 10_000


def page_variance(pixels: DataFrame, key: str = "page_id") -> DataFrame:
    """Population variance of the gray level of each page."""
    level = S.gray_level(F.col("red"), F.col("green"), F.col("blue"))
    return pixels.groupBy(key).agg(F.var_pop(level).alias("variance"))


def with_unreadable(variances: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """All pages, with variance 0.0 where none could be computed."""
    return pages.join(variances, key, "left").withColumn("variance", F.coalesce("variance", F.lit(0.0)))


def top_by_variance(variances: DataFrame, k: int, key: str = "stem", by: Sequence[str] = ()) -> DataFrame:
    """The k pages of highest variance, of the corpus or of each group."""
    order = [F.col("variance").desc(), F.col(key)]
    if by:
        return top_per_group(variances, by, order, k)
    return variances.orderBy(*order).limit(k)


def random_pages(pages: DataFrame, k: int, seed: int = 42, key: str = "stem", by: Sequence[str] = ()) -> DataFrame:
    """A reproducible sample of min(k, n) pages."""
    order = [S.seeded_order(seed, F.col(key)), F.col(key)]
    if by:
        return top_per_group(pages, by, order, k)
    return pages.orderBy(*order).limit(k)


def select_labeled(
    spark: SparkSession,
    pages: DataFrame,
    k: int,
    method: str = "grayscale_variance",
    notes_path: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Stems of k labeled pages.

    A notes file wins if it exists; otherwise *pages* (stem, and variance for that
    method) is ranked by the method.
    """
    if notes_path is not None and _exists(spark, notes_path):
        return notes.pages_of_file(spark, notes_path, method, k).select("stem")
    if method == "grayscale_variance":
        return top_by_variance(pages, k).select("stem")
    if method == "random":
        return random_pages(pages, k, seed).select("stem")
    raise ValueError(f"unknown selection method {method!r}; methods without a rule need notes_path")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def shot_sweep(ranked: DataFrame, shots: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """Membership of ranked pages (rank from 1) in every k-shot set: a row per (k, page)."""
    levels = F.filter(F.array(*[F.lit(k) for k in shots]), lambda k: k >= F.col("rank"))
    return ranked.filter(F.col("rank") <= max(shots)).withColumn("k", F.explode(levels))


def split_labeled(train: DataFrame, labeled: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Labeled and unlabeled training pages; all pages count as unlabeled if none is left."""
    chosen = labeled.select(key).distinct()
    rest = train.join(chosen, key, "left_anti")
    if rest.isEmpty():
        rest = train
    return train.join(chosen, key, "left_semi"), rest


def cyclic_pairs(labeled: DataFrame, unlabeled: DataFrame, order: str = "stem") -> DataFrame:
    """Unlabeled page i with labeled page i modulo the number of labeled pages."""
    n = labeled.count()
    left = row_numbers(labeled.select(F.col(order).alias("labeled")), [], [F.col("labeled")], "slot", start=0)
    right = row_numbers(unlabeled.select(F.col(order).alias("unlabeled")), [], [F.col("unlabeled")], "i", start=0)
    right = right.withColumn("slot", F.col("i") % max(n, 1))
    # With few labeled pages each slot is large: send the labeled side, whose size was just
    # counted, to the tasks.  With many, slots are small and even and a shuffle join does.
    if n <= BROADCAST_ROWS:
        left = F.broadcast(left)
    return right.join(left, "slot").select("i", "labeled", "unlabeled")


def batch_plan(items: DataFrame, batch: int, seed: int, epoch: int, key: str = "stem", drop_last: bool = True) -> DataFrame:
    """Shuffle the items, cut them into batches and drop an incomplete last one if any is full."""
    shuffled = items.withColumn("_key", S.seeded_order(seed, F.lit(epoch), F.col(key)))
    total = items.count()
    placed = row_numbers(shuffled, [], [F.col("_key"), F.col(key)], "place", start=0).drop("_key")
    planned = placed.withColumn("batch", F.floor(F.col("place") / batch))
    if drop_last and total >= batch:
        planned = planned.filter(F.col("batch") < total // batch)
    return planned
