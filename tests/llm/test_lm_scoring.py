"""Scores against counts kept in dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.llm import lm_scoring, words
from scriptoria.llm.common import fold
from scriptoria.llm.ngram_trie import EliasFano, Trie
from scriptoria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows, train, mu=20.0):
    one, two, total, texts = Counter(), Counter(), 0, 0
    for r in filter(train, rows):
        t = tokens(r[1])
        one.update(t)
        two.update(zip(["<begin>", *t], t))
        total, texts = total + len(t), texts + 1
    v = len(one)
    out = []
    for r in rows:
        t = tokens(r[1])
        p = lambda w: (one[w] + 1) / (total + v + 1)
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10((two[h, w] + mu * p(w)) / ((texts if h == "<begin>" else one[h]) + mu)) for h, w in zip(["<begin>", *t], t))
        out.append((r[0], len(t), sum(one[w] > 0 for w in t), total, base, score))
    return out


def compare(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    want = sorted(want, key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], abs=1e-9, rel=1e-12)
        assert g[5] == pytest.approx(w[5], abs=1e-3 * w[1], rel=1e-4)  # values have 16 bits


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op10_lm_scoring"](spark, FOLDER).collect()
    learn = lambda r: zlib.crc32(str(r[0]).encode()) % 7 != 2
    compare(got, brute(rows, learn))
    assert all(r["held_out"] != learn((r["doc_id"],)) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


ROWS = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 17))) for i in range(200)] + [
    (500, None), (501, ""), (502, "hot " * 3000), (503, "Hot\thot\x0bHOT"), (504, "x" * 60_000), (7, "again w1 w2"), (7, "again w1 w2"), (None, "w1 w2"), (505, "é É ß")]


@pytest.mark.parametrize("shard_tokens", [50, 10_000_000])
def test_shards_hot_words_and_odd_rows(spark, shard_tokens):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "text as k1", "doc_id as train", "text as block")
    got = lm_scoring.score_texts(df, fold("doc_id", 7) != 2, shard_tokens=shard_tokens).collect()
    compare(got, brute(ROWS, lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2))


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None)], [(1, "a b")]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    compare(lm_scoring.score_texts(df, F.lit(False)).collect(), brute(rows, lambda r: False))
    compare(lm_scoring.score_texts(df, F.lit(True)).collect(), brute(rows, lambda r: True))


def test_the_model_itself(spark):
    tries = [Trie(bytes(r["trie"])) for r in lm_scoring.language_model(spark.createDataFrame(ROWS, SCHEMA), F.lit(True), shard_tokens=1000).collect()]
    assert len(tries) > 1
    distinct = {w for r in ROWS for w in tokens(r[1])}
    assert sum(t.words.n for t in tries) == len(distinct)
    assert sum(t.contexts.n for t in tries) == len({p for r in ROWS for p in zip(["<begin>", *tokens(r[1])], tokens(r[1]))})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=50), st.integers(1, 62))
def test_elias_fano(values, bits):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(62 - bits))
    coded, _ = EliasFano.view(memoryview(EliasFano.encode(values).to_bytes()), 0)
    assert coded.access(np.arange(len(values))).tolist() == values.tolist()
    for target in [0, *values.tolist(), *(int(v) + 1 for v in values)]:
        found = coded.successor(np.zeros(1, np.int64), np.full(1, len(values)), np.array([target], np.uint64))
        assert found[0] == np.searchsorted(values, np.uint64(target))


def test_hashes_do_not_depend_on_neighbours():
    a, _ = words.word_hashes([b"one two three"])
    b, _ = words.word_hashes([b"", b"  three", b"TWO one"])
    assert a.tolist() == [b[2], b[1], b[0]]


def test_hashes_in_parts(monkeypatch):
    from scriptoria.llm import words

    texts = [b"", b"one", b"  two  words ", "é ü\tß\nA".encode() * 30, b"x" * 500, b"a b " * 200, b" " * 300 + b"z"]
    whole = words.word_hashes(texts)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(words, "CHUNK", size)
        monkeypatch.setattr(words.in_parts, "__defaults__", (size,))
        got = words.hashes_of(texts)
        assert got[0].tolist() == whole[0].tolist() and got[1].tolist() == whole[1].tolist()
