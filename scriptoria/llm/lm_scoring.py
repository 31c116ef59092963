"""Log probabilities of texts under an n-gram model learnt from part of the corpus.

The model is an interpolated bigram model: with c the training counts, N tokens and V
distinct ones, p(w) = (c(w) + 1) / (N + V + 1) and
p(w | h) = (c(h, w) + mu * p(w)) / (c(h) + mu).  Its logarithm is a term of the pair less a
term of the context, so everything a token needs lies with the word itself.

1. Words are counted: N, V and the hot words, of which there are at most twice as many as
   shards.
2. Tasks send each shard of words the pairs (word, context) they hold, with the rows and
   numbers: distinct pairs of a block of texts once, as packed arrays.
3. A shard sums the training counts of its pairs, builds its trie (quantised smoothed values
   on Elias-Fano levels), queries it for every pair it was sent, and answers each block with
   the sums of every row; a hot word's pairs are dealt to all shards by context.
4. The answers are added up by block.

Texts are read twice and never moved; what moves grows with the distinct pairs.

Defined results: null and empty texts have one token, the end; a null id counts as the empty
text for learning; rows equal in id and text have equal scores; without training rows N and V
are 0 and mu alone decides; an empty table gives no rows.  Words and pairs are told apart by
64-bit hashes, contexts within a word's range by 40 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm import words
from scriptoria.llm.common import whole_text
from scriptoria.llm.ngram_trie import CONTEXT_BITS, Trie
from scriptoria.session import checkpointed

END, BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Tokens of a shard on average, and bytes of a block: bounds of a task's memory only.
SHARD_TOKENS, BLOCK_BYTES = 2_000_000, 6_000_000


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the smallest type that holds them, its width first."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Keys (two numbers a row), training flags and texts of about *size* bytes."""
    keys, train, texts, held = [], [], [], 0
    for batch in batches:
        for k1, k2, t, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = text.as_buffer().to_pybytes()
            if texts and held + len(data) > size:
                yield np.array(keys, np.int64), np.array(train, bool), texts
                keys, train, texts, held = [], [], [], 0
            keys.append((k1.as_py(), k2.as_py()))
            train.append(t.as_py())
            texts.append(data)
            held += len(data)
    if texts:
        yield np.array(keys, np.int64), np.array(train, bool), texts


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with an end each, the token before each, and the text of each."""
    hashes, counts = words.hashes_of(texts)
    ends = np.cumsum(counts + 1) - 1
    token = np.empty(len(hashes) + len(texts), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[~is_end], token[is_end] = hashes, END
    before = np.roll(token, 1)
    before[ends - counts] = BEGIN
    return token, before, np.repeat(np.arange(len(texts), dtype=np.int32), counts + 1)


def prepared(docs: DataFrame, train: Column, text: str, doc_id: str) -> DataFrame:
    """k1, k2 (the row's identity), train, text."""
    name, whole = docs[doc_id].cast("string"), whole_text(docs[text])
    return docs.select(F.xxhash64(name, whole).alias("k1"), F.xxhash64(whole, F.lit(1), name).alias("k2"), train.alias("train"), whole.alias("text"))


COUNTS = "word bigint, trained bigint, held bigint"


def word_counts(rows: DataFrame) -> DataFrame:
    """word, trained, held: how often each word stands in training rows and in all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, train, texts in blocks(batches, 4 * BLOCK_BYTES):
            parts = []
            # numbers of a part of the block at a time, then of the block
            for a in range(0, len(texts), 512):
                token, _, doc = stream(texts[a:a + 512])
                w, place, n = np.unique(token, return_inverse=True, return_counts=True)
                parts.append((w, np.bincount(place, train[a:a + 512][doc], len(w)).astype(np.int64), n))
            token, trained, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
            w, place = np.unique(token, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), pa.array(np.bincount(place, trained, len(w)).astype(np.int64)), pa.array(np.bincount(place, held, len(w)).astype(np.int64))],
                ["word", "trained", "held"])

    return rows.mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("held").alias("held"))


class Spread:
    """Which shard a pair goes to: by its word, or by word and context where the word is hot."""

    def __init__(self, shards: int, hot: np.ndarray, hot_counts: np.ndarray):
        order = np.argsort(hot)
        self.shards, self.hot, self.hot_counts = shards, hot[order], hot_counts[order]

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        at = np.minimum(np.searchsorted(self.hot, token), len(self.hot) - 1)
        return at, self.hot[at] == token

    def __call__(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        _, hot = self.find(token)
        spread = words.mix(np.where(hot, token ^ words.mix(context), token))
        return ((spread >> np.uint64(33)) * np.uint64(self.shards) >> np.uint64(31)).astype(np.int64)


MESSAGE = ("shard int, block bigint, rows int, keys binary, train binary, words binary, word_pairs binary, contexts binary, pair_rows binary, row binary, times binary")


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes, the first place included."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def messages(rows: DataFrame, spread: Spread) -> DataFrame:
    """What blocks send to shards; the keys of a block's rows go to one shard only."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for index, (keys, train, texts) in enumerate(blocks(batches, BLOCK_BYTES)):
            block = (part << 32) | index
            token, before, doc = stream(texts)
            context = before >> np.uint64(64 - CONTEXT_BITS)
            del before
            shard = spread(token, context).astype(np.int32)
            rank = np.unique(token, return_inverse=True)[1] << CONTEXT_BITS
            rank |= context.view(np.int64)
            order = np.lexsort((rank, shard))
            del rank
            shard, token, context, doc = shard[order], token[order], context[order], doc[order]
            del order
            e = starts_of(shard, token, context, doc)
            times = np.diff(np.append(e, len(token)))
            shard, token, context, doc = shard[e], token[e], context[e], doc[e]
            p = starts_of(shard, token, context)
            pair_rows = np.diff(np.append(p, len(token)))
            w = starts_of(shard[p], token[p])
            word_pairs = np.diff(np.append(w, len(p)))
            bytes5 = context[p].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8]
            home = int(words.mix(np.array([block], np.uint64))[0] % np.uint64(spread.shards))
            flags = np.packbits(train).tobytes()
            out = []
            for s in sorted({home, *np.unique(shard).tolist()}):
                ea, eb = np.searchsorted(shard, [s, s + 1])
                pa_, pb = np.searchsorted(shard[p], [s, s + 1])
                wa, wb = np.searchsorted(shard[p][w], [s, s + 1])
                out.append((s, block, len(texts), keys.tobytes() if s == home else None, flags, token[p][w][wa:wb].tobytes(), pack(word_pairs[wa:wb]),
                            bytes5[pa_:pb].tobytes(), pack(pair_rows[pa_:pb]), pack(doc[ea:eb]), pack(times[ea:eb])))
            kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in MESSAGE.split(", ")])

    return rows.mapInArrow(send, MESSAGE)


class Shard:
    """All messages of one shard, its pairs and their training counts."""

    def __init__(self, mail: list[dict]):
        self.mail = mail
        word, context, pair_rows, row, times, train, base = [], [], [], [], [], [], 0
        for m in mail:
            word.append(np.repeat(np.frombuffer(m["words"], np.uint64), unpack(m["word_pairs"])))
            five = np.frombuffer(m["contexts"], np.uint8).reshape(-1, CONTEXT_BITS // 8)
            eight = np.zeros((len(five), 8), np.uint8)
            eight[:, : five.shape[1]] = five
            context.append(eight.view("<u8").ravel())
            pair_rows.append(unpack(m["pair_rows"]))
            row.append(unpack(m["row"]) + base)
            times.append(unpack(m["times"]))
            train.append(np.unpackbits(np.frombuffer(m["train"], np.uint8))[: m["rows"]].astype(bool))
            base += m["rows"]
        self.rows = base
        word, context, pair_rows, self.row, self.times, train = map(np.concatenate, (word, context, pair_rows, row, times, train))
        self.sent = np.repeat(np.arange(len(pair_rows), dtype=np.int32), pair_rows)  # of each entry, the sent pair
        trained = np.bincount(self.sent, self.times * train[self.row], len(pair_rows)) if len(pair_rows) else np.zeros(0)
        self.names, at = np.unique(word, return_inverse=True)
        self.at, self.context = at.astype(np.int32), context  # of each sent pair
        key = (at.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | context
        del word, at, pair_rows
        order = np.argsort(key)
        key = key[order]
        first = starts_of(key)
        self.count = np.add.reduceat(trained[order], first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        pair = key[first]
        del key, order, trained
        self.owner = (pair >> np.uint64(CONTEXT_BITS)).astype(np.int32)
        self.contexts = pair & np.uint64((1 << CONTEXT_BITS) - 1)
        self.word_count = np.bincount(self.owner, self.count, len(self.names)).astype(np.int64)

    def trie(self, spread: Spread, total: int, distinct: int, mu: float) -> tuple[bytes, np.ndarray]:
        """The trie of the trained words and pairs, and the training counts of all names."""
        at, hot = spread.find(self.names)
        counts = np.where(hot, spread.hot_counts[at] if len(spread.hot) else 0, self.word_count)
        known = counts > 0
        alone = mu * (counts + 1.0) / (total + distinct + 1)
        seen = self.count > 0
        position = np.cumsum(known) - 1
        values = np.log10(self.count[seen] + alone[self.owner[seen]])
        return Trie.build(self.names[known], np.log10(alone[known]), position[self.owner[seen]], self.contexts[seen], values), counts


SUMS = ("tokens", "known", "base", "model")
ANSWER = "block bigint, rows int, keys binary, tokens binary, known binary, base binary, model binary"
#: Pairs looked up at once: a bound of memory only.
LOOKUP = 250_000


def scores(sent: DataFrame, spread: Spread, total: int, distinct: int, mu: float) -> DataFrame:
    """Each shard's sums for the rows of each block: tokens, known, base, model."""
    def answer(table: pa.Table) -> pa.Table:
        shard = Shard(table.to_pylist())
        data, counts = shard.trie(spread, total, distinct, mu)
        del shard.count, shard.owner, shard.contexts
        trie = Trie(data)
        at, there = trie.find(shard.names)
        pair = np.full(len(shard.at), np.log10(mu / (total + distinct + 1)))
        for a in range(0, len(pair), LOOKUP):
            which = shard.at[a:a + LOOKUP]
            known = np.flatnonzero(there[which])
            place, found = trie.lookup(at[which[known]], shard.context[a + known])
            pair[a + known] = trie.alone[at[which[known]]]
            pair[a + known[found]] = trie.pairs[place[found]]
        del shard.context
        # the word is the context of what follows, unless it is the end
        pair -= np.where(shard.names == END, 0.0, np.log10(counts + mu))[shard.at]
        plain = np.log10((counts + 1.0) / (total + distinct + 1))
        name = shard.at[shard.sent]
        sums = [np.bincount(shard.row, shard.times * v, shard.rows) for v in (1, (counts > 0)[name])]
        sums = [s.astype(np.int64) for s in sums] + [np.bincount(shard.row, shard.times * v, shard.rows) for v in (plain[name], pair[shard.sent])]
        ends = np.cumsum([m["rows"] for m in shard.mail])
        parts = []
        for m, e in zip(shard.mail, ends, strict=True):
            tokens, known, base, model = (s[e - m["rows"]:e] for s in sums)
            # the model's values have 16 bits, so single precision loses nothing of them
            parts.append((pack(tokens), pack(known), base.tobytes(), model.astype(np.float32).tobytes()))
        return pa.table({
            "block": pa.array([m["block"] for m in shard.mail], pa.int64()), "rows": pa.array([m["rows"] for m in shard.mail], pa.int32()),
            "keys": pa.array([m["keys"] for m in shard.mail], pa.binary()), **{c: pa.array([p[i] for p in parts], pa.binary()) for i, c in enumerate(SUMS)}})

    return sent.groupBy("shard").applyInArrow(answer, ANSWER)


SCORED = "k1 bigint, k2 bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def added(answers: DataFrame, begin: float) -> DataFrame:
    """Sums over all shards of every row; *begin* is the term of the context before the first word."""
    def add(table: pa.Table) -> pa.Table:
        keys, total = None, [0, 0, 0.0, 0.0]
        for m in table.to_pylist():
            parts = (unpack(m["tokens"]), unpack(m["known"]), np.frombuffer(m["base"], np.float64), np.frombuffer(m["model"], np.float32).astype(np.float64))
            total = [t + p for t, p in zip(total, parts, strict=True)]
            if m["keys"] is not None:
                keys = np.frombuffer(m["keys"], np.int64).reshape(-1, 2)
        return pa.table({
            "k1": keys[:, 0], "k2": keys[:, 1], "n_tokens": total[0].astype(np.int64), "n_known": total[1].astype(np.int64),
            "base_score": total[2], "score": total[3] - begin})

    return answers.groupBy("block").applyInArrow(add, SCORED)


def score_texts(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", mu: float = 20.0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: one row per row of *docs*.

    *train* says which rows the model is learnt from.
    """
    spark = docs.sparkSession
    rows = prepared(docs, train, text, doc_id)
    counts = checkpointed(word_counts(rows))
    sums = counts.agg(
        F.sum("trained").alias("total"), F.count(F.when(F.col("trained") > 0, 1)).alias("distinct"), F.sum("held").alias("held"),
        F.max(F.when(F.col("word") == int(END.view(np.int64)), F.col("trained"))).alias("texts")).first()
    total, distinct, held, texts = (int(sums[c] or 0) for c in ("total", "distinct", "held", "texts"))
    shards = max(1, -(-held // shard_tokens))
    # words with more than half a shard's tokens: at most twice as many as shards
    hot = counts.where(F.col("held") * 2 * shards > held).select("word", "trained").collect() if shards > 1 else []
    spread = Spread(shards, np.array([r["word"] for r in hot], np.int64).view(np.uint64), np.array([r["trained"] for r in hot], np.int64))
    scored = added(scores(messages(rows, spread), spread, total, distinct, mu), float(np.log10(texts + mu)))
    scored = scored.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    named = docs.select(F.col(doc_id).alias("doc_id"), train.alias("train"), F.xxhash64(docs[doc_id].cast("string"), whole_text(docs[text])).alias("k1"),
                        F.xxhash64(whole_text(docs[text]), F.lit(1), docs[doc_id].cast("string")).alias("k2"))
    return named.join(scored, ["k1", "k2"]).select("doc_id", "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def language_model(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", mu: float = 20.0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """shard, trie: the model itself, a :class:`Trie` a shard of words."""
    rows = prepared(docs, train, text, doc_id).where("train")
    sums = word_counts(rows).agg(F.sum("trained").alias("total"), F.count("*").alias("distinct")).first()
    total, distinct = int(sums["total"] or 0), int(sums["distinct"] or 0)
    spread = Spread(max(1, -(-total // shard_tokens)), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def build(table: pa.Table) -> pa.Table:
        data, _ = Shard(table.to_pylist()).trie(spread, total, distinct, mu)
        return pa.table({"shard": table["shard"][:1], "trie": pa.array([data], pa.binary())})

    return messages(rows, spread).groupBy("shard").applyInArrow(build, "shard int, trie binary")
