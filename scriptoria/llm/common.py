"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.session import checkpointed, ensure_checkpoint_dir

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


#: What Spark hands to Python at once: whole texts are long, so the default of 10,000 rows holds too much.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, for executors with little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo *folds* (a null id counts as the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds


def stored(df: DataFrame) -> DataFrame:
    """*df* written to a table of its own in the shared checkpoint folder, and read back.

    Like a checkpoint, but nothing of the plan is carried on: a checkpointed frame keeps the
    constraints of its plan, which grow with every round of an iteration.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once nothing that is still to run reads them."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_in)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that *df* does not use (names compare without case)."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def bound(value: Column, body) -> Column:
    """*body* of a column that is computed once, however often lambdas in *body* read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def span_list(spans: Column, keep: Column | None = None) -> Column:
    """kind:start:end of an array of span structs, comma-joined in the array's order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


#: Bits of a sketch of keys (2 MB), as a power of two: more keys only let more other rows through.
KEY_BITS = 24


def among(key: Column, keys: DataFrame) -> Column:
    """Whether a 64-bit hash may be one of *keys* (a column of such hashes): true for all of them, and for few others.

    A bit sketch of fixed size goes to the tasks, so that rows which no key can match are not moved.
    """
    cell = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - KEY_BITS) + 1
    parts = keys.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")).collect()
    size = max((len(r["bits"]) for r in parts), default=1)
    bits = np.zeros(-(-(1 << KEY_BITS) // (8 * size)) * size, np.uint8)
    for r in parts:
        bits[(r["part"] - 1) * size: r["part"] * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def found(hashes: pa.Array) -> pa.Array:
        at = (hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        return pa.array((sent.value[at >> 3] >> (at & 7)) & 1 == 1)

    return found(key)


def keep_marked(docs: DataFrame, keys: list[Column], decisions: DataFrame) -> DataFrame:
    """The rows of *docs* that *decisions* (k0, k1, ..., kept) keeps, with their columns.

    Keys are computed on both sides; rows equal in all keys are interchangeable, and as many
    as are kept of them (all, none or one) stay.  Only what is dropped is joined, so a table
    that loses few rows is not moved.
    """
    names = [free_name(docs, f"keep_k{i}") for i in range(len(keys))]
    theirs = [free_name(docs, f"lost_k{i}") for i in range(len(keys))]
    rows, stay = free_name(docs, "keep_rows"), free_name(docs, "keep_stay")
    lost = decisions.groupBy(*(F.col(f"k{i}").alias(k) for i, k in enumerate(theirs))).agg(
        F.count("*").alias(rows), F.sum(F.col("kept").cast("int")).alias(stay)).where(F.col(rows) > F.col(stay))
    lost = checkpointed(lost)
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    touched = among(F.xxhash64(*(keyed[k] for k in names)), lost.select(F.xxhash64(*theirs).alias("key")))
    near = keyed.where(touched)
    same = F.lit(True)
    for name, k in zip(names, theirs, strict=True):
        same = same & near[name].eqNullSafe(lost[k])
    joined = near.join(lost, same, "left")
    whole = keyed.where(~touched).select(*docs.columns).unionByName(joined.where(F.col(rows).isNull()).select(*docs.columns))
    one = joined.where(F.col(stay) > 0).dropDuplicates(names).select(*docs.columns)
    return whole.unionByName(one)
