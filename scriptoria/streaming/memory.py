"""Per-class memory kept over a stream of vectors, in Spark's own state.

The last n vectors of a class are its state; Spark versions it with the query's checkpoint,
restores it after a failure and counts each vector once.  Before the exchange every task
keeps at most n vectors of a class, so a class with most of the rows costs no more than any
other, and a batch sends at most n rows of each class and task to the state.

Vectors without arrival are not kept.  Of equal arrivals the greater vector counts as later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "label int, arrival long, embedding array<float>"
STATE = "arrivals array<long>, embeddings array<array<float>>"

Vectors = list[tuple[int, list[float] | None]]


def latest(vectors: Vectors, n: int) -> Vectors:
    """The *n* last vectors, latest first."""
    return sorted(vectors, key=lambda v: (v[0], v[1] or []), reverse=True)[:n]


def vectors_of(rows: pd.DataFrame) -> Vectors:
    return [(int(a), None if e is None else [float(x) for x in e]) for a, e in zip(rows["arrival"], rows["embedding"], strict=True)]


def task_latest(n: int):
    """At most *n* vectors of each class from each task."""
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int | None, Vectors] = {}
        for rows in batches:
            for label, own in rows.groupby("label", dropna=False):
                label = None if pd.isna(label) else int(label)
                held[label] = latest(held.get(label, []) + vectors_of(own), n)
        for label, own in held.items():
            yield pd.DataFrame({"label": pd.array([label] * len(own), "Int32"), "arrival": [a for a, _ in own], "embedding": [e for _, e in own]})

    return keep


def memory_updates(vectors: DataFrame, n: int) -> DataFrame:
    """The memory of every class that a batch changes, as rows of label, arrival, embedding.

    *vectors* is a stream with label, arrival, embedding; write the result in update mode.
    """
    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: Vectors = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in batches:
            held = latest(held + vectors_of(rows), n)
        state.update(([a for a, _ in held], [e for _, e in held]))
        label = None if pd.isna(key[0]) else int(key[0])
        yield pd.DataFrame({"label": pd.array([label] * len(held), "Int32"), "arrival": [a for a, _ in held], "embedding": [e for _, e in held]})

    fresh = vectors.where("arrival is not null").select(F.col("label").cast("int").alias("label"), F.col("arrival").cast("long").alias("arrival"), "embedding")
    fresh = fresh.mapInPandas(task_latest(n), SCHEMA)
    return fresh.groupBy("label").applyInPandasWithState(merge, SCHEMA, STATE, "update", GroupStateTimeout.NoTimeout)


def keep_last_per_class(vectors: DataFrame, n: int, checkpoint: str, **trigger) -> StreamingQuery:
    """Run a query that keeps the last *n* vectors of each class in the state of *checkpoint*."""
    writer = memory_updates(vectors, n).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_memory(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The memory after the last batch, or after *batch*, from the state; no rows before the first batch."""
    reader = spark.read.format("statestore")
    if batch is not None:
        reader = reader.option("batchId", batch)
    try:
        state = reader.load(checkpoint)
    except SparkRuntimeException as e:
        if e.getCondition() == "STDS_COMMITTED_BATCH_UNAVAILABLE":
            return spark.createDataFrame([], SCHEMA)
        raise
    held = state.select("key.label", F.explode(F.arrays_zip("value.groupState.arrivals", "value.groupState.embeddings")).alias("held"))
    return held.select("label", F.col("held.arrivals").alias("arrival"), F.col("held.embeddings").alias("embedding"))


def stream_vectors(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int | None = None) -> DataFrame:
    """A stream over parquet files that keep arriving in *folder*."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("label", F.col("arrival").cast("long").alias("arrival"), "embedding")
