"""Exact duplicates against a dictionary of normalised texts."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import exact_dedup, golomb

SCHEMA = "doc_id long, text string, lang string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, (1 << 60) - 1), max_size=60), st.sampled_from([1 << 60, 1 << 10, 1]))
def test_golomb_round_trip(values, span):
    values = np.unique(np.array(values, np.int64) % span)
    bits, code = golomb.encode(values, span)
    assert golomb.decode(len(values), bits, code).tolist() == values.tolist()


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), (doc_id is not None, doc_id or 0)))
    out = []
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])
        out.append((doc_id, best[1][1] if best[1][0] else None, len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


ROWS = [(i, f"text {i % 50}", "en") for i in range(300)] + [(1000 + i, "hot   line" + " " * (i % 4), "en") for i in range(200)] + [
    (1, "a b", "x"), (2, "ab", "x"), (3, "a\tb ", "x"), (3, "a\tb ", "x"), (4, None, None), (5, "", None), (6, " \n", "x"), (None, "ab   ", "x"),
    (7, "é b", "x"), (7, "other", "x"), (8, "a b", "x"), (9, "x" * 100_000, "x"), (10, "x" * 99_999 + " x", "x"), (11, "a\x0bb", "x")]


@pytest.mark.parametrize("parts", [1, 7])
def test_groups(spark, parts):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    out = exact_dedup.duplicates(df, owner_rows=50).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key((r["doc_id"], r["keep_id"], r["group_size"], r["sha"].hex()) for r in out) == key(brute(ROWS))
    stay = [r["sha"] for r in out if r["kept"]]
    assert len(stay) == len(set(stay)) == len({r["sha"] for r in out})


def test_what_stays(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df = df.withColumn("dup_id", df.doc_id).withColumn("sha", df.lang).withColumn("row", df.lang)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    first = {}
    for doc_id, text, _ in ROWS:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        rank = (-len(text or ""), (doc_id is not None, doc_id or 0))
        if norm not in first or rank < first[norm][0]:
            first[norm] = rank, (doc_id, text)
    assert [d for d, _ in got] == [d for d, _ in sorted((v[1] for v in first.values()), key=str)]


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, None, None)], [(1, "a", "b")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = exact_dedup.duplicates(df).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len({r["sha"] for r in out})
    assert exact_dedup.drop_copies(df).count() == len({t for _, t, _ in rows})
