"""One query per operator, over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import byte_bpe, exact_dedup, filter_audit, html_template, jaccard_join, lm_scoring, mixing, oracles, pii, quality, secrets, sentencepiece_bpe, source_divergence, vector_graph
from scriptoria.llm.common import fold, of_kinds, span_list, table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def long_count(array: Column) -> Column:
    return F.size(array).cast("long")


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 3) != 1))
    scored = quality.score_quality(docs.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_secret_scan", oracles.secret_scan(secrets.PATTERNS, secrets.BASE_KINDS, secrets.LEAST_ASSIGNED))
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *(long_count(of_kinds(F.col("secrets"), (k,))).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        F.sha2(span_list(of_kinds(F.col("secrets"), secrets.BASE_KINDS)), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
        long_count(F.filter("secrets", lambda s: s["live"])).alias("n_live"))


@query("op4_source_mixing", oracles.MIXING)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("at.doc_id", "at.size", "source_size", "target", "taken")


@query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_bpe.add_ids(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    decoded = sentencepiece_bpe.decode(F.col("ids"), path)
    return coded.select(
        "doc_id", long_count(F.col("ids")).alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"))


@query("op6_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(long_count(of_kinds(F.col("pii"), (k,))).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(span_list(of_kinds(F.col("pii"), pii.BASE_KINDS)), 256).alias("base_sha256"),
        span_list(F.col("pii")).alias("spans"),
        F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


@query("op8_exact_dedup", oracles.EXACT_DEDUP)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op2_html_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = html_template.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "extracted.text", F.length("extracted.text").cast("long").alias("n_chars"))


@query("op7_vector_search")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = vector_graph.nearest(rows, rows.where(F.col("id") % 100 == 0))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


@query("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar(table(spark, folder, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id", "links")


@query("op10_lm_scoring")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scoring.score_texts(table(spark, folder, "documents"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_filter_audit", oracles.FILTER_AUDIT)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    filters = filter_audit.text_filters(whole_text())
    flags = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    steps = filter_audit.audit(filter_audit.masks(docs, filters, "E", flags), [*filters, "E"])
    return steps.select("*", F.col("lost")[0].alias("good_lost"), F.col("lost")[1].alias("toxic_lost")).drop("lost")


@query("op12_source_divergence", oracles.SOURCE_DIVERGENCE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.diverge(table(spark, folder, "documents"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.add_ids(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    ids = F.col("coded.ids")
    return coded.select(
        "doc_id", long_count(ids).alias("n_tokens"), F.sha2(byte_bpe.packed(ids), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode(F.col("coded"), path), 256).alias("decoded_sha256"))
