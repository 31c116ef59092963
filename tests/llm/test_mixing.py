"""Targets and taken words of the mix."""

import random

import pytest

from scriptoria.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water_fill(sizes):
    """Share by weight, stop at twice the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def collect(df):
    return [r.asDict(recursive=True) for r in mixing.mix(df, bucket_rows=7).collect()]


@pytest.mark.parametrize("case", ["skewed", "even", "one", "nulls"])
def test_targets_and_taken(spark, case):
    rnd = random.Random(case)
    pick = {"skewed": ["hot"] * 40 + ["a", "b", "c", "d"], "even": list("abcdef"), "one": ["x"], "nulls": [None, "é", "a", "z", "😀"]}[case]
    rows = [(i, " ".join(["word"] * rnd.randint(0, 30)), rnd.choice(pick)) for i in range(400)]
    rows += [(7, None, pick[0]), (7, None, pick[0]), (8, "same same", pick[0]), (8, "same same", pick[0]), (None, "x y", None)]
    out = collect(spark.createDataFrame(rows, SCHEMA))
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = water_fill(sizes), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["at"]["size"] and r["taken"] >= r["epochs"] * r["at"]["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, total in taken.items():
        assert abs(total - want[source]) < 1 + 1e-6
    key = lambda rs: sorted(str(r) for r in rs)
    assert key(out) == key(collect(spark.createDataFrame(rows, SCHEMA).repartition(5)))


def test_bucket_width_does_not_matter(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9), "s" if i % 3 else "t") for i in range(300)], SCHEMA)
    rows = [sorted(str(r) for r in mixing.mix(df, bucket_rows=n).collect()) for n in (1, 10, 10_000)]
    assert rows[0] == rows[1] == rows[2]


def test_take_gives_whole_documents(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "s" if i % 3 else "t") for i in range(300)] + [(1, None, "s"), (2, "", None)], SCHEMA)
    df = df.withColumn("at", df.text).withColumn("mix_at", df.doc_id).withColumn("copies", df.doc_id)
    out, mixed = mixing.take(df), mixing.mix(df)
    assert out.columns == df.columns
    got, want = {}, {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    for r in mixed.collect():
        n = r["epochs"] + (r["part"] > 0 and 2 * r["part"] >= r["at"]["size"])
        if n and r["at"]["size"]:
            want[r["at"]["doc_id"]] = n
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (1, "", "a")]])
def test_nothing_to_take(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["taken"], r["target"]) for r in mixing.mix(df).collect()] == [(0, 0.0)] * len(rows)
    assert mixing.take(df).collect() == []
