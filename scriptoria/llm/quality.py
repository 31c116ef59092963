"""Quality by compression: the label whose dictionary compresses a text better is likelier.

Two zstandard dictionaries are built from blocks of good and bad labelled texts.  A text
is cut into blocks, each block is compressed with either dictionary, and normalised
differences of the total sizes (bad against good, plain against good) go through a
logistic calibration fitted on other labelled texts.  Scoring is a narrow step over whole
texts; only the two dictionaries (at most ``dictionary_bytes`` each) and three
coefficients travel to the tasks.

What is learnt comes from a bounded sample of the labelled rows: at most ``sample_rows``
rows of each label and part (dictionaries, calibration) by a hash of the id, and at most
``sample_blocks`` blocks of ``block`` characters of each label for the dictionaries.

Defined results: null and empty texts get the score of a text without evidence (the
intercept); without rows of one label the score is the share of good labels, or 0.5
without labels; labels that are null are not used; repeated ids count once, the higher
label holds; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import free_name, whole_text


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries, and the weights of the logistic calibration of the two size differences."""

    good: bytes
    bad: bytes
    intercept: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    block: int = 512
    level: int = 1


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """Compresses single blocks against a dictionary, without headers of their own."""
    dictionary = zstandard.ZstdCompressionDict(content)
    params = zstandard.ZstdCompressionParameters.from_level(
        level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def size_differences(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, block: int) -> tuple[float, float]:
    """(bad - good) / (bad + good) and (plain - good) / (plain + good) over all blocks; zeros without bytes."""
    g = b = 0
    for at in range(0, len(data), block):
        piece = data[at:at + block]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return ((b - g) / (b + g), (len(data) - g) / (len(data) + g)) if data else (0.0, 0.0)


DIFFERENCES = pa.struct([("labels", pa.float64()), ("plain", pa.float64())])


def differences(model: QualityModel, text: Column) -> Column:
    """The normalised size differences of a text column, as a struct."""
    @F.arrow_udf("struct<labels:double,plain:double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        good, bad = compressor(model.good, model.level), compressor(model.bad, model.level)
        for texts in batches:
            found = [size_differences(t.as_buffer().to_pybytes(), good, bad, model.block) for t in texts]
            yield pa.array([{"labels": a, "plain": b} for a, b in found], DIFFERENCES)

    return measure(text)


def score(model: QualityModel, text: str | Column = "text") -> Column:
    """Probability that a text is good; null and empty texts have one too."""
    if not model.good:
        return F.lit(1 / (1 + float(np.exp(-model.intercept))))
    d = differences(model, whole_text(text))
    return 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slopes[0]) * d["labels"] + F.lit(model.slopes[1]) * d["plain"])))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there are too few samples to train on, their content itself."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[:size] or b"\n" * 8


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-4) -> np.ndarray:
    """Intercept and slopes by Newton steps, with a small ridge on the scaled slopes."""
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    pull = np.diag([1e-9] + [ridge * len(x)] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + pull, z.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / spread
    return np.array([w[0] - slopes @ centre, *slopes])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, sample_blocks: int = 4000,
          dictionary_bytes: int = 110_000, block: int = 512, level: int = 1) -> QualityModel:
    """Learn from *labels* (doc_id, quality 0 or 1) and the texts of *docs* (doc_id, text)."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(17))
    marked = marked.select("doc_id", "quality", order.alias("at"), (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2))).alias("part"))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not n_good or not n_bad:
        share = (n_good + 0.5) / (n_good + n_bad + 1) if n_good + n_bad else 0.5
        return QualityModel(b"", b"", float(np.log(share / (1 - share))), (0.0, 0.0), block, level)
    chosen = [
        marked.where((F.col("quality") == q) & (F.col("part") == p)).orderBy("at", "doc_id").limit(sample_rows)
        for q in (0, 1) for p in (0, 1)
    ]
    # at most 4 * sample_rows ids: small by the limit above, so sending them to the tasks is safe
    sample = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).unionByName(chosen[3]).toPandas()
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sample, "doc_id long, quality int, at long, part long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text")).join(F.broadcast(wanted), "doc_id")

    blocks = texts.where("part = 0").select(
        "quality", "doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(block))).alias("start"))
    blocks = blocks.select("quality", F.xxhash64("doc_id", "start").alias("at"), F.substr("text", F.col("start"), F.lit(block)).alias("piece"))
    pieces: dict[int, list[bytes]] = {}
    for q in (0, 1):
        rows = blocks.where(F.col("quality") == q).orderBy("at", "piece").limit(sample_blocks).collect()
        pieces[q] = [r["piece"].encode() for r in rows]
    model = QualityModel(dictionary(pieces[1], dictionary_bytes), dictionary(pieces[0], dictionary_bytes), block=block, level=level)

    points = texts.select("quality", "doc_id", "part", differences(model, F.col("text")).alias("d"))
    points = points.groupBy("quality", "doc_id", "part").agg(F.avg("d.labels").alias("labels"), F.avg("d.plain").alias("plain"))
    points = points.orderBy("quality", "doc_id").toPandas()
    held = points[points["part"] == 1]
    if held["quality"].nunique() == 2:  # else too few labels to calibrate on texts of their own
        points = held
    y = points["quality"].to_numpy(float)
    intercept, *slopes = fit_logistic(points[["labels", "plain"]].to_numpy(float), y)
    # the sample holds other shares of the labels than the corpus: move the intercept to the labels' odds
    intercept += np.log(n_good / n_bad) - np.log(max(0.5, y.sum()) / max(0.5, len(y) - y.sum()))
    return replace(model, intercept=float(intercept), slopes=(float(slopes[0]), float(slopes[1])))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """*docs* with the probability of good quality in column *out*."""
    return docs.withColumn(out, score(model, text))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of *docs* whose score reaches *threshold*, with their columns."""
    name = free_name(docs, "quality_score")
    return score_quality(docs, model, out=name).where(F.col(name) >= threshold).select(*docs.columns)
