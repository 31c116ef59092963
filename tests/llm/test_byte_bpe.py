"""Byte-level encoding against the tiktoken library, pre-tokens against the pattern."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import byte_bpe, pre_tokens
from scriptoria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
ODD = "abstmdrevl ST é١①😀\u0085  　'’\n\t\r\x1c\x00-.,=#9½Ⅻ中\U0001e5e7Ᲊ"


def same(texts):
    vocabulary = byte_bpe.load(PATH)
    ids, n = byte_bpe.Encoder(vocabulary)(texts)
    assert len(n) == len(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == LIBRARY.encode_ordinary(text), repr(text)
        assert vocabulary.bytes_of(part) == text.encode()


@settings(max_examples=800, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=60), min_size=1, max_size=6))
def test_odd_texts(texts):
    same(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_unicode(texts):
    same([t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ast re.v'l1 \n\t", max_size=300), st.integers(1, 9), st.integers(1, 5))
def test_scan_in_parts_and_blocks(text, chunk, block):
    held = pre_tokens.CHUNK, pre_tokens.BLOCK
    pre_tokens.CHUNK, pre_tokens.BLOCK = chunk, block + 1
    try:
        got = pre_tokens.boundaries(text, np.zeros(0, np.int64)).tolist()
    finally:
        pre_tokens.CHUNK, pre_tokens.BLOCK = held
    assert got == [m.start() for m in PATTERN.finditer(text)]


def test_every_character():
    # of the long blocks of ideographs and of planes without letters every 50th
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 < c < 0xAC00 or 0xF900 < c < 0x17000 or 0x1AFF0 < c < 0x20000 or c % 50 == 0)]
    texts = [f"a{c}1{c}!{c} {c}'s" for c in chars]
    encoder = byte_bpe.Encoder(byte_bpe.load(PATH))
    for at in range(0, len(texts), 50_000):
        part = texts[at:at + 50_000]
        ids, n = encoder(part)
        expected = LIBRARY.encode_ordinary_batch(part)
        assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]


def test_long_pieces():
    rng = np.random.default_rng(3)
    same(["a" * 100_000, "ab" * 50_000, "".join(map(chr, rng.integers(97, 123, 60_000))), "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))),
          " " * 50_000 + "x", "\n" * 5000 + " ", "=-" * 20_000, "the end", "7" * 30_000, *("x9" * n + "=" * n for n in range(30, 70)), "'ll've's" * 1000])


def test_a_long_text_in_parts():
    text = "It's a text, isn't it?  We've 123 things\n\n 中文字 and more.\t" * 20_000
    same([text, "", text[:77]])


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 50)
    encoder = byte_bpe.Encoder(byte_bpe.load(PATH))
    for k in range(30):
        text = " ".join(f"word{k * i}" for i in range(40)) + " " + "z" * 300
        assert encoder([text])[0].tolist() == LIBRARY.encode_ordinary(text)
        assert len(encoder.slots) <= 50 + 90


def test_offsets_that_do_not_fit():
    vocabulary = byte_bpe.load(PATH)
    ids = np.array(LIBRARY.encode_ordinary("some words"))
    with pytest.raises(ValueError):
        vocabulary.bytes_of(ids, np.arange(len(ids)))


def test_query_equals_library(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, ""), (2, "a b"), (2, "a b")]])
def test_nulls_repeats_and_clashing_names(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as ids", "text as offsets")
    out = byte_bpe.add_ids(df, PATH)
    assert out.columns == [*df.columns, "coded"]
    got = out.withColumn("again", byte_bpe.decode(out["coded"], PATH)).collect()
    assert sorted(bytes(r["again"]).decode() for r in got) == sorted(r[1] or "" for r in rows)
    for r in got:
        assert list(r["coded"]["offsets"]) == np.cumsum([0] + [len(LIBRARY.decode_single_token_bytes(i)) for i in r["coded"]["ids"]]).tolist()[:-1]
    with pytest.raises(ValueError):
        byte_bpe.add_ids(df, PATH, out="IDS")
