"""Per-class vector memory and assignment of vectors to class prototypes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.operators.scan import attach_group_values, row_numbers, top_per_group
from scriptoria.session import checkpointed

# Prototypes one task holds at a time.
BLOCK = 4096
# Similarities are compared to this many decimals, so that the order of summation does not decide ties.
DECIMALS = 12


def last_per_class(vectors: DataFrame, n: int, key: str = "label", arrival: str = "vec_id") -> DataFrame:
    """The last *n* vectors of each class by arrival.

    Each task keeps at most n rows of a class before the shuffle, so a class that
    holds most rows costs no more than any other.
    """
    return top_per_group(vectors, [key], [F.col(arrival).desc()], n, "age")


def first_per_class(vectors: DataFrame, key: str = "label", arrival: str = "vec_id") -> DataFrame:
    """The first vector of each class, its prototype."""
    return vectors.groupBy(key).agg(F.min_by("embedding", arrival).alias("embedding"))


def _best_of_block(vector: Column, matrix: np.ndarray) -> Column:
    kind = T.StructType([T.StructField("cost", T.DoubleType()), T.StructField("at", T.IntegerType())])

    @F.pandas_udf(kind)
    def best(batch: pd.Series) -> pd.DataFrame:
        x = np.stack(batch.to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        similarity = np.round((x / np.maximum(norm, 1e-12)) @ matrix.T, DECIMALS)
        top = similarity.argmax(axis=1)
        return pd.DataFrame({"cost": -similarity[np.arange(len(x)), top], "at": top.astype(np.int32)})

    return best(vector)


def assign_to_prototypes(
    vectors: DataFrame, prototypes: DataFrame, key: str = "label", keep: Sequence[str] = ("vec_id",), block: int = BLOCK
) -> DataFrame:
    """Class of highest cosine similarity for each vector, the lowest class on ties.

    Prototypes are one row per class; classes may be of any type.  Up to *block* of them,
    which are counted first, go to the tasks as one matrix and no row is shuffled.  More
    are compared in chunks that stay distributed; rows that agree in *keep* stay apart.
    """
    if prototypes.count() > block:
        return _assign_by_chunks(vectors, prototypes, key, keep)
    rows = prototypes.select(key, "embedding").orderBy(key).collect()
    if not rows:
        return vectors.select(*keep, F.lit(None).cast(prototypes.schema[key].dataType).alias("cls"), F.lit(None).cast("double").alias("similarity")).limit(0)
    classes = F.array(*[F.lit(r[key]).cast(prototypes.schema[key].dataType) for r in rows])
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    best = vectors.select(*keep, _best_of_block(F.col("embedding"), matrix).alias("b"))
    return best.select(*keep, F.get(classes, F.col("b.at")).alias("cls"), (-F.col("b.cost")).alias("similarity"))


def _assign_by_chunks(vectors, prototypes, key, keep, size: int = 256):
    """Each vector meets each chunk of prototypes; its best of every chunk, then the best of those.

    Chunks hold *size* prototypes and are copied over several salts, so that no task
    gets all vectors of a chunk.
    """
    numbered = row_numbers(prototypes.select(key, "embedding"), [], [F.col(key)], "_n", start=0)
    numbered = numbered.withColumn("chunk", F.floor(F.col("_n") / size))
    chunks = numbered.groupBy("chunk").agg(F.collect_list(F.struct(F.col(key).alias("cls"), "embedding")).alias("members"))
    last = (prototypes.count() - 1) // size
    # the row's own number keeps rows with equal keys apart; it is stored, as it is read after a shuffle
    numbered_rows = checkpointed(vectors.select(*keep, "embedding").withColumn("_row", F.monotonically_increasing_id()))
    met = numbered_rows.select("_row", *keep, "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("chunk"))
    rows = attach_group_values(met, chunks, ["chunk"], salts=64)

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    own = F.greatest(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), F.lit(1e-12))
    scored = F.transform("members", lambda m: F.struct(
        (-F.round(dot(F.col("embedding"), m["embedding"]) / (own * F.greatest(F.sqrt(dot(m["embedding"], m["embedding"])), F.lit(1e-12))), DECIMALS)).alias("cost"),
        m["cls"].alias("cls"),
    ))
    best = rows.select("_row", *keep, F.array_min(scored).alias("b")).groupBy("_row", *keep).agg(F.min("b").alias("b"))
    return best.select(*keep, F.col("b.cls").alias("cls"), (-F.col("b.cost")).alias("similarity"))
