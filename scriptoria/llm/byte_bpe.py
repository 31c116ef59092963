"""Byte-level BPE encoding and decoding.

The texts of a batch are joined and cut into pre-tokens at once (see ``pre_tokens``).  Each
distinct pre-token is merged once and remembered; ids of a text are slices of one flat array.
A pre-token that is in the vocabulary is one id; others merge the pair of least rank, the
leftmost of equal ones, until no pair is in the vocabulary: short ones as the rows of matrices,
long ones with a heap of pairs, in time n log n for n bytes.  With the ids go their offsets, the byte of the text at
which each begins: decoding lays the bytes of each id at its offset.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows are
rows of their own; an empty table gives no rows; other columns stay, the output column must
be a new name.
"""

from __future__ import annotations

import base64
import bisect
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import whole_text
from scriptoria.llm.pre_tokens import boundaries

#: Characters encoded together, pre-tokens cut together and remembered by a task: bounds of memory only.
BATCH_CHARS, CUT, CACHED = 300_000, 100_000, 200_000
#: Pre-tokens longer than this are merged but not remembered.
LONGEST_CACHED = 200
#: Widths of the matrices in which pre-tokens are merged together; longer ones are merged one by one with a heap.
WIDTHS = (6, 9, 12, 16, 24, 40, 100)
#: No id.
NONE = (1 << 31) - 1
CODED = "struct<ids:array<int>,offsets:array<int>>"


class Vocabulary:
    """Ranks of byte strings; a rank is the id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every byte")
        # what two ids become, for every way to cut a token into two
        self.pair = {}
        for token, k in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = k
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.keys = np.array(sorted(self.pair), np.int64)
        self.merged = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        self.first = self.lookup(*np.meshgrid(self.byte, self.byte, indexing="ij"))
        size = np.zeros(max(self.rank.values()) + 1, np.int64)
        by_id = sorted((k, token) for token, k in self.rank.items())
        size[[k for k, _ in by_id]] = [len(token) for _, token in by_id]
        self.size, self.at = size, np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(token for _, token in by_id), np.uint8)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pre-tokens and the number of ids of each; *pieces* are distinct."""
        whole = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        found = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        rest = sorted(np.flatnonzero(whole < 0).tolist(), key=lambda k: len(pieces[k]))
        lengths = [len(pieces[k]) for k in rest]
        at = 0
        for width in WIDTHS:
            upto = bisect.bisect_right(lengths, width)
            if upto > at:
                found.append(self.merge_short([pieces[k] for k in rest[at:upto]], np.array(rest[at:upto]), width))
            at = upto
        for k in rest[at:]:
            ids = self.merge_long(pieces[k])
            found.append((np.full(len(ids), k), np.array(ids)))
        piece, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(piece, kind="stable")
        return ids[order].astype(np.int32), np.bincount(piece, minlength=len(pieces))

    def merge_short(self, pieces: list[bytes], names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Name and id of every part of many pre-tokens; each round merges the best pair of each, so that all rows lose one column."""
        size = np.array([len(p) for p in pieces])
        code = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        part = np.where(np.arange(width) < size[:, None], self.byte[code], NONE)  # NONE pads
        rank = np.where(part[:, 1:] < NONE, self.first[code[:, :-1], code[:, 1:]], NONE)
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(part):
            i = rank.argmin(axis=1)  # the leftmost of equal ones
            row = np.arange(len(part))
            least = rank[row, i]
            over = least == NONE
            if over.any():
                own = part[over] < NONE
                done.append((np.repeat(names[over], own.sum(axis=1)), part[over][own]))
                part, rank, names, i, least = part[~over], rank[~over], names[~over], i[~over], least[~over]
                row = np.arange(len(part))
                if not len(part):
                    break
            part[row, i] = least
            stay = np.ones(part.shape, bool)
            stay[row, i + 1] = False
            part = part[stay].reshape(len(row), -1)
            stay = np.ones(rank.shape, bool)
            stay[row, i] = False
            rank = rank[stay].reshape(len(row), -1)
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < rank.shape[1])
            rank[left, i[left] - 1] = self.lookup(part[left, i[left] - 1], least[left])
            rank[right, i[right]] = self.lookup(least[right], part[right, i[right] + 1])
            if not rank.shape[1]:
                done.append((names, part[:, 0]))
                break
        return tuple(np.concatenate([d[k] for d in done]) for k in (0, 1))

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What pairs of ids become; NONE where they do not merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def merge_long(self, piece: bytes) -> list[int]:
        """By a heap of pairs."""
        get, n = self.pair.get, len(piece)
        part = self.byte[np.frombuffer(piece, np.uint8)].tolist()  # -1 where a part has been joined to the one before
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(r, i) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(pairs)
        while pairs:
            r, i = heapq.heappop(pairs)
            j = after[i]
            if part[i] < 0 or j == n or get(part[i] << 32 | part[j]) != r:
                continue  # one of the two has been merged since
            part[i], part[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get(r << 32 | part[k])) is not None:
                    heapq.heappush(pairs, (x, i))
            h = before[i]
            if h >= 0 and (x := get(part[h] << 32 | r)) is not None:
                heapq.heappush(pairs, (x, h))
        return [p for p in part if p >= 0]

    def bytes_of(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes that ids stand for, each id's laid at its offset (one after another, if none are given)."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        starts = ends - size
        if offsets is not None and not np.array_equal(offsets, starts):
            raise ValueError("offsets don't fit the ids")
        return self.data[np.repeat(self.at[ids] - starts, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


class Encoder:
    """Encodes groups of texts and remembers pre-tokens between them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pre-tokens and the number of ids of each."""
        if len(self.slots) > CACHED:
            self.forget()
        slots = self.slots
        new = sorted((p for p in set(pieces) if p not in slots), key=len)
        slots.update(zip(new, range(len(slots), len(slots) + len(new)), strict=True))
        ids, counts = self.vocabulary.merge_all([p.encode() for p in new])
        flat, sizes = np.append(self.flat, ids), np.append(self.size, counts)
        which = np.fromiter(map(slots.__getitem__, pieces), np.int64, len(pieces))
        n = sizes[which]
        shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
        out = flat[np.repeat(shift, n) + np.arange(int(n.sum()))]
        while new and len(new[-1]) > LONGEST_CACHED:  # the longest stand last
            del slots[new.pop()]
        self.size = sizes[:len(slots)].copy()
        self.flat = flat[:int(self.size.sum())].copy()
        return out, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        joined = "\n".join(texts)
        stops = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
        starts = boundaries(joined, stops)
        ends = np.append(starts[1:], len(joined))
        own = np.ones(len(starts), bool)
        own[np.searchsorted(starts, stops)] = False
        starts, ends = starts[own], ends[own]
        ids, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(starts), CUT):
            part = slice(at, at + CUT)
            got = self.pieces([joined[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            ids.append(got[0])
            n.append(got[1])
        upto = np.append(0, np.cumsum(np.concatenate(n)))
        last = upto[np.append(np.searchsorted(starts, stops), len(starts))]
        return np.concatenate(ids), np.diff(last, prepend=0)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


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
    """Struct of the ids of a text column and their byte offsets; *path* is readable on every executor."""
    @F.arrow_udf(CODED)
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(path)
        encoder = Encoder(vocabulary)
        for texts in batches:
            for group in groups(texts):
                ids, n = encoder(group)
                ends = np.append(0, np.cumsum(n)).astype(np.int32)
                upto = np.append(0, np.cumsum(vocabulary.size[ids]))
                offsets = (upto[:-1] - np.repeat(upto[ends[:-1]], n)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, offsets)]
                yield pa.StructArray.from_arrays(lists, ["ids", "offsets"])

    return coded(whole_text(text))


def decode(coded: Column, path: str) -> Column:
    """The bytes of a struct of ids and offsets; null stands for no ids."""
    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(path)
        for structs in batches:
            ids, offsets = (structs.field(k) for k in (0, 1))
            ends, flat, at = ids.offsets.to_numpy(), ids.values.to_numpy(), offsets.values.to_numpy()
            ends_at = offsets.offsets.to_numpy()
            for k in range(0, len(structs), 100):
                yield pa.array([vocabulary.bytes_of(flat[ends[i]:ends[i + 1]], at[ends_at[i]:ends_at[i + 1]]) for i in range(k, min(k + 100, len(structs)))], pa.binary())

    empty = F.expr("cast(array() as array<int>)")
    return decoded(F.coalesce(coded, F.struct(empty.alias("ids"), empty.alias("offsets"))))


def packed(ids: Column) -> Column:
    """The ids as little-endian unsigned 32-bit numbers in one binary value."""
    @F.arrow_udf("binary")
    def as_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            ends, data = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            yield pa.array([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return as_bytes(F.coalesce(ids, F.expr("cast(array() as array<int>)")))


def add_ids(docs: DataFrame, path: str, text: str = "text", out: str = "coded") -> DataFrame:
    """*docs* with the ids of its text and their offsets in the new column *out*."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the column {out} is there already")
    return docs.withColumn(out, encode(F.col(text), path))
