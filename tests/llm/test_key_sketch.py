"""Rows that no key can match are not moved."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from scriptoria.llm import common, exact_dedup, jaccard_join
from scriptoria.operators import scan


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_among_has_every_key_and_few_others(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h")).unionByName(spark.createDataFrame([(-1, -1), (-2, 0), (-3, 2**63 - 1), (-4, -(2**63))], "id long, h long"))
    keys = rows.where("id < 100").select("h")
    found = {r.id for r in rows.where(common.among(F.col("h"), keys)).collect()}
    assert found >= {*range(100), -1, -2, -3, -4} and len(found) < 130
    assert rows.where(common.among(F.col("h"), keys.limit(0))).isEmpty()


def test_only_what_may_be_dropped_is_joined(spark):
    docs = spark.range(500).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 450).alias("text"))
    keys = [docs["doc_id"], F.xxhash64(docs["text"])]
    told = docs.select(F.col("doc_id").alias("k0"), F.xxhash64("text").alias("k1"), (F.col("text") != "text 7").alias("kept"))
    kept = common.keep_marked(docs, keys, told)
    assert sorted(r.text for r in kept.collect()) == sorted(r.text for r in docs.where("text <> 'text 7'").collect())
    # the sketch stands below the join; before, whole rows were joined
    assert "found(xxhash64" in plan_of(kept)


def test_copies_are_dropped_as_before(spark):
    rows = [(i, f"some words {i % 7} of a text that is here") for i in range(40)] + [(None, "alone"), (None, "some words 3 of a text that is here"), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    kept = sorted(exact_dedup.drop_copies(docs).collect(), key=str)
    assert sorted(r.text or "" for r in kept) == sorted({r[1] or "" for r in rows})


def test_tasks_of_the_join_follow_the_shingles(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.similar(docs).collect()))
    seen = []

    def spread(df, *keys, rows=0):
        out = scan.spread(df, *keys, rows=rows)
        seen.append((rows, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(scan, "TASK_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "spread", spread)
    assert sorted(map(tuple, jaccard_join.similar(docs).collect())) == want
    assert len({w[3] for w in want}) == 20 and seen[0][1] == -(-seen[0][0] // 20) > 4
