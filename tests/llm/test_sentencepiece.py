"""Encoding and decoding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import sentencepiece_bpe as bpe
from scriptoria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(texts):
    model = bpe.load(PATH)
    for text, ids in zip(texts, model.encode_all(texts), strict=True):
        assert ids.tolist() == LIBRARY.encode(text), repr(text)
        assert model.decode(ids) == LIBRARY.decode(LIBRARY.encode(text)), repr(text)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="abcdet hn.\n▁ é١ﬁ①😀\x00\t=-", max_size=60), max_size=6))
def test_any_text(texts):
    same(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_unicode(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


def test_runs_long_words_and_blanks():
    same(["", " ", "   ", "\n\n \n", "a" * 5000, "aab" * 700, " " * 999 + "x" + " " * 77, "======" * 300, "ha" * 2000 + "\n", "1234567890" * 100, "▁▁▁a", "<s></s><0x41><unk>"])


def test_documents_in_one_batch(spark):
    same([r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()])


def test_merging_one_by_one_gives_the_same():
    model = bpe.load(PATH)
    words = [" the", " internationalisation", "aaaaaaa", "      x", "£€ﬁ"]
    a, n = model.encode_segments(words)
    b, m = model.encode_segments(words, one_by_one=True)
    assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_decode_any_ids(ids):
    assert bpe.load(PATH).decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_query_equals_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_sentencepiece"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, ""), (2, "a b"), (2, "a b")]])
def test_nulls_repeats_and_clashing_names(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as ids", "text as segments")
    out = bpe.add_ids(df, PATH, out="codes")
    assert out.columns == [*df.columns, "codes"]
    got = out.withColumn("again", bpe.decode(out["codes"], PATH)).collect()
    assert sorted((r["again"] for r in got)) == sorted(r[1] or "" for r in rows)
