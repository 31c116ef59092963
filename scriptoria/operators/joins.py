"""Joins of pages with files by name."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_pages(files: DataFrame, kinds: list[str], key: str = "stem") -> DataFrame:
    """Pages with a file of every kind, one column of paths per kind.

    One aggregation over the listing instead of a chain of joins.
    """
    paths = [F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds]
    return files.filter(F.col("kind").isin(kinds)).groupBy(key).agg(*paths).dropna(subset=kinds)


# Shapes of names beyond which texts are cut into all their substrings.
SHAPES = 1000


def _shape(text: Column) -> Column:
    """The text with every ASCII digit as 0 and every ASCII letter as a, character by character."""
    return F.translate(text, string.digits + string.ascii_letters, "0" * 10 + "a" * 52)


def contains_join(files: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs where the text column of *files* contains the name column of *names*.

    Every text is cut into its substrings of the lengths names have, so the pairs
    come from an equality join.  Lengths and texts are limited by what a file
    system allows in a name.  Where names have few shapes (which places hold digits and
    which letters), substrings of other shapes are left out before they are moved.
    """
    lengths = sorted(r[0] for r in names.select(F.length(name)).filter(F.length(name) > 0).distinct().collect())
    if not lengths:
        return files.join(names, F.lit(False))
    shapes = [r[0] for r in names.filter(F.length(name) > 0).select(_shape(F.col(name))).distinct().limit(SHAPES + 1).collect()]
    t, shape = F.col(text), F.col("_shape")

    def pieces(n: int):
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        if len(shapes) <= SHAPES:
            starts = F.filter(starts, lambda i: F.substring(shape, i, F.lit(n)).isin([s for s in shapes if len(s) == n]))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    substrings = F.array_distinct(F.concat(*[pieces(n) for n in lengths]))
    shaped = files.withColumn("_shape", _shape(t))
    return shaped.select(*files.columns, F.explode(substrings).alias("_piece")).join(
        names.withColumn("_piece", F.col(name)), "_piece"
    ).drop("_piece")
