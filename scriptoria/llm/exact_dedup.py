"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. Every row gets the SHA-256 of its normalised text and a 60-bit fingerprint out of it;
   the rows without their texts are written to the checkpoint folder.
2. Every partition sorts its distinct fingerprints and sends each owner, who holds a range
   of fingerprints, a Golomb code of its part and a bitmap of those it holds twice itself.
3. Owners answer every message with a bitmap of the fingerprints that others sent as well.
4. Partitions mark their rows by the bitmaps.  Only the texts of these suspects are moved,
   compared byte by byte and grouped.

A value that a third of the rows hold costs each partition one fingerprint and each task
one partly aggregated row.  Owners are as many as rows need (``owner_rows`` each at most on
average).  Suspect ids select the texts by a sketch of fixed size and a semi join, which Spark
broadcasts only below its own size threshold and sorts otherwise.

Defined results: null counts as the empty text, and empty texts are copies of each other; a
null id comes before other ids; of rows equal in text, length and id one stays; an empty
table gives no rows.  Two different texts with one SHA-256 stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import golomb
from scriptoria.llm.common import SPACE, among, keep_marked, whole_text
from scriptoria.session import checkpointed

FINGERPRINT_BITS = 60
MESSAGE = "owner int, pid int, n int, bits int, code binary, twice binary"
ANSWER = "pid int, owner int, n int, marks binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(whole_text(text), f"[{SPACE}]+", "")


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges in order."""
    return (((prints >> (FINGERPRINT_BITS - 30)) * owners) >> 30).astype(np.int32)


def sorted_prints(prints: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fingerprints, how often each is held, and the owners with the ends of their parts."""
    values, held = np.unique(prints, return_counts=True)
    names, starts = np.unique(owner_of(values, owners), return_index=True)
    return values, held, names, np.append(starts, len(values))


def messages(rows: DataFrame, owners: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        pids, prints = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
        for pid in np.unique(pids):
            values, times, names, ends = sorted_prints(prints[pids == pid], owners)
            out = []
            for name, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                bits, code = golomb.encode(values[a:b], 1 << FINGERPRINT_BITS)
                out.append((int(name), int(pid), int(b - a), bits, code, np.packbits(times[a:b] > 1).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(),) * 4 + (pa.binary(),) * 2, strict=True)],
                ["owner", "pid", "n", "bits", "code", "twice"])

    return rows.select("pid", "print").mapInArrow(send, MESSAGE)


def answers(sent: DataFrame) -> DataFrame:
    def reply(table: pa.Table) -> pa.Table:
        mail = table.to_pylist()
        values = np.concatenate([golomb.decode(m["n"], m["bits"], m["code"]) for m in mail])
        twice = np.concatenate([np.unpackbits(np.frombuffer(m["twice"], np.uint8))[: m["n"]] for m in mail]).astype(bool)
        _, place, senders = np.unique(values, return_inverse=True, return_counts=True)
        marks = np.split(twice | (senders[place] > 1), np.cumsum([m["n"] for m in mail])[:-1])
        return pa.table({
            "pid": pa.array([m["pid"] for m in mail], pa.int32()), "owner": pa.array([m["owner"] for m in mail], pa.int32()),
            "n": pa.array([m["n"] for m in mail], pa.int32()), "marks": pa.array([np.packbits(x).tobytes() for x in marks], pa.binary())})

    return sent.groupBy("owner").applyInArrow(reply, ANSWER)


def marked(rows: DataFrame, replies: DataFrame, owners: int) -> DataFrame:
    """*rows* with the column suspect; each group is one partition of the input, without texts."""
    def mark(held: pa.Table, mail: pa.Table) -> pa.Table:
        prints = held["print"].to_numpy()
        values, _, names, ends = sorted_prints(prints, owners)
        answer = {m["owner"]: m for m in mail.to_pylist()}
        flags = np.zeros(len(values), bool)
        for name, a, b in zip(names.tolist(), ends[:-1], ends[1:], strict=True):
            flags[a:b] = np.unpackbits(np.frombuffer(answer[name]["marks"], np.uint8))[: b - a]
        return held.append_column("suspect", pa.array(flags[np.searchsorted(values, prints)]))

    schema = rows.withColumn("suspect", F.lit(True)).schema
    return rows.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(mark, schema)


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner_rows: int = 1_000_000) -> DataFrame:
    """doc_id, length, sha, keep_id, group_size, kept: one row per row of *docs*."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.length(whole_text(text)).alias("length"), F.sha2(normalised(F.col(text)), 256).alias("hex"))
    rows = checkpointed(rows.select(
        "doc_id", "length", F.unhex("hex").alias("sha"), F.conv(F.substring("hex", 1, FINGERPRINT_BITS // 4), 16, 10).cast("long").alias("print"),
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("row")))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // owner_rows))
    told = checkpointed(marked(rows, answers(messages(rows, owners)), owners).drop("print", "pid"))
    suspects, single = told.where("suspect").drop("suspect"), told.where("not suspect")

    ids = suspects.select(F.col("doc_id").alias("suspect_id")).distinct()
    near = docs.where(among(F.xxhash64(docs[doc_id]), ids.select(F.xxhash64("suspect_id").alias("key"))))
    texts = near.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("bytes")).join(ids, F.col("id").eqNullSafe(F.col("suspect_id")), "left_semi")
    compared = texts.groupBy("bytes").agg(F.count("*").alias("rows")).groupBy(F.unhex(F.sha2("bytes", 256)).alias("sha")).agg(F.count("*").alias("texts"))
    best = F.min(F.struct((-F.col("length")).alias("shorter"), "doc_id", "row"))
    groups = suspects.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")).join(compared, "sha")
    groups = groups.select("sha", "best", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two different texts have one SHA-256")).cast("long")).alias("group_size"))
    grouped = suspects.join(groups, "sha").select(
        "doc_id", "length", "sha", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    alone = single.select("doc_id", "length", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of *docs* that stay, with their columns: of equal rows one."""
    keys = [docs[doc_id], F.length(whole_text(docs[text])), F.unhex(F.sha2(normalised(docs[text]), 256))]
    found = duplicates(docs, text, doc_id).select(F.col("doc_id").alias("k0"), F.col("length").alias("k1"), F.col("sha").alias("k2"), "kept")
    return keep_marked(docs, keys, found)
