"""Mixing sources to target weights by weighted sampling without replacement.

Every source gets a target number of words.  Whole epochs of a source come first: each
document is taken as often as its whole source fits.  The rest is a fraction of an epoch,
chosen by exponential keys scaled by quality weights: a document's key is -ln(u) / weight
with u from a hash of its id, the documents of a source are taken by ascending key until
the prefix sum of their sizes reaches the rest, and the document at the boundary is taken
for the words that still fit.

Only DataFrame functions are used.  A source may hold any share of the rows: its key range
is cut into as many buckets as its rows need (``bucket_rows`` rows on average), sizes are
summed by bucket, and the running sum of a row is the sum of the buckets before its own
plus the sum within its bucket.  Texts are not shuffled.

Defined results: null and empty texts have size 0 and nothing is taken of them; a null
source is a source of its own, last in order; rows that are equal in id and text are drawn
one after the other; without any word nothing is taken and targets are 0; an empty table
gives no rows; other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import SPACE, free_name, whole_text
from scriptoria.session import checkpointed

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
_BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of runs without white space: each becomes one x, then blanks go."""
    return F.length(F.translate(F.regexp_replace(text, f"[^{SPACE}]+", "x"), _BLANKS, "")).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1.1: the share of lower-case letters (any script) among the characters of a text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{Ll}]+", ""))
    return F.lit(0.1) + F.coalesce(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, from the md5 of a key."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"#{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, rows, target from source, source_size and rows: one row a source.

    The total is shared by weight; a target stops at MOST_EPOCHS times its source's size
    and the excess is shared again.  That ends at one level times weight below the stop, so
    sources are gone through by stop / weight and the first level that fits is taken.  The
    windows without a key hold one row a source, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (pick + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("stop", F.col("source_size") * MOST_EPOCHS).withColumn("ratio", F.col("stop") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("stop").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighted.withColumn("level", (F.sum("source_size").over(every) * F.lit(TOTAL_SHARE) - before) / left)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return leveled.withColumn("level", fits).select(
        "source", "source_size", "rows", F.least(F.col("stop").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop").cast("double"))).alias("target"))


def place(docs: DataFrame, text: str, doc_id: str, seed: int) -> Column:
    """The place of a row in its source's order: key, then what tells rows apart."""
    whole = whole_text(docs[text])
    key = -F.ln(uniform(F.coalesce(docs[doc_id].cast("string"), F.lit("")), seed)) / quality_weight(whole)
    return F.struct(key.alias("key"), docs[doc_id].alias("doc_id"), word_count(whole).alias("size"), F.xxhash64(whole).alias("text_hash"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7,
        bucket_rows: int = 20_000) -> DataFrame:
    """source, at (key, doc_id, size, text_hash), source_size, target, epochs, part, taken: one row per document."""
    rows = checkpointed(docs.select(F.col(source).alias("source"), place(docs, text, doc_id, seed).alias("at"))).select("source", "at", "at.size")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = checkpointed(targets(by_source).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).alias("buckets")))
    plan = plan.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    # one row a source: joined as Spark sees fit
    keyed = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    # keys are about exponential: equal steps of 1 - exp(-key) hold about as many rows
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("at.key") / 2)) * F.col("buckets")).cast("long"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(up), F.lit(0))).drop("in_bucket")
    sums = sums.withColumnRenamed("source", "source_").withColumnRenamed("bucket", "bucket_")
    within = Window.partitionBy("source", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.col("inside")))
    return summed.select("source", "at", "source_size", "target", "epochs", part.alias("part"), (F.col("epochs") * F.col("size") + part).alias("taken"))


def take(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix in whole documents: every row as many times as it is taken, with its columns.

    The document at a source's boundary counts as taken if at least half of it fits.  The
    boundary is one row a source, so texts stay where they are read.
    """
    mixed = mix(docs, text, doc_id, source, seed)
    chosen = (F.col("part") > 0) & (2 * F.col("part") >= F.col("at.size"))
    ends = mixed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(chosen, F.col("at"))).alias("last"))
    names = {n: free_name(docs, f"mix_{n}") for n in ("source", "epochs", "last", "at", "copy")}
    ends = checkpointed(ends.select(*(F.col(c).alias(names[c]) for c in ("source", "epochs", "last"))))
    at = F.col(names["at"])
    copies = F.col(names["epochs"]) + F.coalesce((at <= F.col(names["last"])).cast("int"), F.lit(0))
    placed = docs.withColumn(names["at"], place(docs, text, doc_id, seed)).join(ends, F.col(source).eqNullSafe(F.col(names["source"])))
    placed = placed.where((at["size"] > 0) & (copies > 0)).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return placed.select(*docs.columns)
