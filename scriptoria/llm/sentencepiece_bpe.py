"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The model's vocabulary is read with the sentencepiece library; encoding is done here.  A
text is cut into segments that no piece crosses (before a blank, around a line feed), each
distinct segment of a batch is encoded once, and all segments are encoded together: flat
arrays of symbols, the least pair rank of every word by a segmented minimum, all leftmost
merges of that rank at once, compaction, until no pair remains.

Merging all pairs of one rank at once equals merging one after the other unless a merge
makes a pair of an equal or better rank.  Words where that happens are noticed and done
again with one merge a round.

Defined results: null and empty texts have no ids and decode to the empty text; line feeds,
control characters and characters without a piece become byte pieces; U+2581 in a text
counts as a blank, as in the library; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import whole_text

BLANK = "▁"
NONE = np.iinfo(np.int32).max
#: Characters encoded at once, segments remembered by a task, rows decoded at once: bounds of memory only.
BATCH_CHARS = 300_000
CACHED_SEGMENTS = 200_000
DECODED_ROWS = 500
#: Texts a model must encode as the library does before it is used.
PROBES = ("", " ", "a", "  a  b ", "x\ny", "▁q", "é①ﬁ\x00\t", "aaaaaaaa", "The end. 123 456", "ﬀ 　 ½")


def _byte_by_byte(err: UnicodeError):
    return "�", err.start + 1


codecs.register_error("scriptoria-bytes", _byte_by_byte)


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The concatenation of the slices *which* of a flat array."""
    n = sizes[which]
    shift = starts[which] - (np.cumsum(n) - n)
    return values[np.repeat(shift, n) + np.arange(int(n.sum()))]


class Bpe:
    """Vocabulary tables of one model."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {pieces[i]: i for i in plain}
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        # characters that are only part of pieces get symbols of their own behind the vocabulary
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, n + len(symbols) - len(ids))
        self.size, self.width = n, n + len(symbols) - len(ids)
        self.char = np.full(0x110000, -1, np.int32)
        for text, k in symbols.items():
            if len(text) == 1:
                self.char[ord(text)] = k
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (place[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = sp.unk_id()
        self.fallback = bool(sp.is_byte(int(self.bytes[65])))
        self.splits_lines = not any("\n" in p for p in ids)
        crossing = [p for p in ids if re.search(f"[^{BLANK}]{BLANK}", p)]
        # decoding: the bytes each id stands for
        out = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        out[self.unknown] = sp.decode([self.unknown]).encode()
        self.out, self.out_at, self.out_size = _flat(out)
        self.blank_first = np.array([p.startswith(BLANK) for p in pieces])
        if crossing or not self.fallback or any(self.encode_all([p])[0].tolist() != sp.encode(p) for p in PROBES):
            raise ValueError("only BPE models with byte fallback, a blank before words and no normalisation are encoded here")

    # encoding

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(BLANK, " ")
        return re.findall(r" *+[^ \n]+| +|\n" if self.splits_lines else r" *+[^ ]+| +", text)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; NONE where they do not merge."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def encode_segments(self, words: list[str], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.char[code]
        word = np.repeat(np.arange(len(words)), sizes)
        code = -code - 1  # below zero: a single character; merged symbols get 0
        last_rank = np.full(len(words), -1, np.int64)
        again = np.zeros(len(words), bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            inner = word[:-1] == word[1:]
            rank = np.full(len(word), NONE, np.int32)
            merged = np.zeros(len(word), np.int32)
            rank[:-1], merged[:-1] = self.lookup(symbol[:-1], symbol[1:])
            rank[:-1][~inner] = NONE
            starts = np.flatnonzero(np.concatenate(([True], ~inner)))
            least = np.minimum.reduceat(rank, starts)
            if not one_by_one:
                again[word[starts]] |= least <= last_rank[word[starts]]
            last_rank[word[starts]] = least
            length = np.diff(np.append(starts, len(word)))
            open_ = np.repeat((least < NONE) & ~again[word[starts]], length)
            if not open_.all():
                shut = ~open_ & ~again[word]
                done.append((word[shut], symbol[shut], code[shut]))
                word, symbol, code, rank, merged = word[open_], symbol[open_], code[open_], rank[open_], merged[open_]
                if not len(word):
                    break
            take = rank == last_rank[word]
            if one_by_one:
                at = np.flatnonzero(take)
                take[:] = False
                take[at[np.append(True, word[at[1:]] != word[at[:-1]])]] = True
            else:
                # overlapping pairs: every second one of a run, from its left end
                at = np.arange(len(take))
                begin = np.maximum.accumulate(np.where(take & ~np.append(False, take[:-1]), at, -1))
                take &= (at - begin) % 2 == 0
                near = np.flatnonzero(take[:-2] & take[2:] & (word[:-2] == word[2:]))
                if len(near):
                    between, _ = self.lookup(merged[near], symbol[near + 2])
                    again[word[near[between <= last_rank[word[near]]]]] = True
            symbol = np.where(take, merged, symbol)
            code = np.where(take, 0, code)
            stay = np.append(True, ~take[:-1])
            word, symbol, code = word[stay], symbol[stay], code[stay]
        word, symbol, code = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))
        if again.any():
            redo = np.flatnonzero(again)
            ids, n = self.encode_segments([words[i] for i in redo], one_by_one=True)
            word, symbol, code = np.append(word, np.repeat(redo, n)), np.append(symbol, ids), np.append(code, np.zeros(len(ids), np.int64))
        order = np.argsort(word, kind="stable")
        word, symbol, code = word[order], symbol[order], code[order]
        raw = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(raw):
            as_bytes = [chr(-c - 1).encode("utf-8", "replace") for c in code[raw].tolist()]
            n = np.ones(len(symbol), np.int64)
            n[raw] = [len(b) for b in as_bytes]
            word, symbol = np.repeat(word, n), np.repeat(symbol, n)
            first = np.cumsum(n) - n
            where = np.repeat(first[raw], n[raw]) + np.concatenate([np.arange(len(b)) for b in as_bytes])
            symbol[where] = self.bytes[np.frombuffer(b"".join(as_bytes), np.uint8)]
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return list(Encoder(self)(texts))

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.out_size[ids]
        data = gather(self.out, self.out_at, self.out_size, ids).tobytes()
        some = np.flatnonzero(sizes)
        if len(some) and self.blank_first[ids[some[0]]]:
            data = data[1:]
        return data.decode("utf-8", "scriptoria-bytes")


class Encoder:
    """Encodes batches and remembers segments between them."""

    def __init__(self, model: Bpe):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.slots) > CACHED_SEGMENTS:
            self.forget()
        cut = [self.model.segments(t) for t in texts]
        new = [s for s in dict.fromkeys(s for c in cut for s in c) if s not in self.slots]
        if new:
            ids, n = self.model.encode_segments(new)
            self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
            self.flat, self.size = np.append(self.flat, ids), np.append(self.size, n)
        start = np.cumsum(self.size) - self.size
        for c in cut:
            which = np.fromiter(map(self.slots.__getitem__, c), np.int64, len(c))
            yield gather(self.flat, start, self.size, which)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in groups of about BATCH_CHARS characters."""
    group, chars = [], 0
    for t in texts:
        text = t.as_py() or ""
        if group and chars + len(text) > BATCH_CHARS:
            yield group
            group, chars = [], 0
        group.append(text)
        chars += len(text)
    if group:
        yield group


def encode(text: Column, path: str) -> Column:
    """The ids of a text column, without begin or end ids; *path* is readable on every executor."""
    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(load(path))
        for texts in batches:
            for group in groups(texts):
                ids = list(encoder(group))
                ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                yield pa.ListArray.from_arrays(ends, np.concatenate(ids))

    return ids_of(whole_text(text))


def decode(ids: Column, path: str) -> Column:
    """The text of an id column; null ids give the empty text."""
    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for lists in batches:
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for at in range(0, len(lists), DECODED_ROWS):
                part = ends[at:at + DECODED_ROWS + 1]
                yield pa.array([model.decode(flat[a:b]) for a, b in zip(part[:-1], part[1:], strict=True)], pa.string())

    return text_of(F.coalesce(ids, F.expr("cast(array() as array<int>)")))


def add_ids(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """*docs* with the ids of its text in column *out*."""
    return docs.withColumn(out, encode(F.col(text), path))
