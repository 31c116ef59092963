"""A two-level n-gram trie in Elias-Fano coded arrays.

Level one holds words, level two the words that stood before each of them (the trie is
reversed: the predicted word is the root).  Both levels are monotone sequences, as are the
pointers from a word to its range in level two; each word and pair has a smoothed value in
16 bits.  A trie is one byte string, and reading it only makes views into that string, so
it can be mapped from memory or taken from a table cell alike.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a context's identity within the range of a word.
CONTEXT_BITS = 40
LEVELS = 65535


class EliasFano:
    """A non-decreasing sequence: whole low bytes apart, high parts as gaps in unary."""

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low.reshape(n, low_bytes), high
        self._ones: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length())
        low_bytes = min(8, (bits + 7) // 8)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes]
        upper = (values >> np.uint64(8 * low_bytes) if low_bytes < 8 else np.zeros(n, np.uint64)).astype(np.int64)
        unary = np.zeros(int(upper[-1]) + n if n else 0, np.uint8)
        unary[upper + np.arange(n)] = 1
        return cls(n, low_bytes, np.ascontiguousarray(low).ravel(), np.packbits(unary))

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the positions *index*."""
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high)).astype(np.int64)
        value = np.zeros(len(index), np.uint64)
        for k in range(self.low_bytes):
            value |= self.low[index, k].astype(np.uint64) << np.uint64(8 * k)
        if self.low_bytes < 8:
            value |= (self._ones[index] - index).astype(np.uint64) << np.uint64(8 * self.low_bytes)
        return value

    def successor(self, first: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each range first..last-1 the first position whose value reaches *target* (or last)."""
        low, high = first.astype(np.int64).copy(), last.astype(np.int64).copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.access(middle) < target[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", self.n, self.low_bytes, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def view(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bytes, high = struct.unpack_from("<qqq", data, at)
        at += 24
        low = np.frombuffer(data, np.uint8, n * low_bytes, at)
        at += n * low_bytes
        return cls(n, low_bytes, low, np.frombuffer(data, np.uint8, high, at)), at + high


class Quantised:
    """Numbers rounded to equal steps between their extremes."""

    def __init__(self, least: float, step: float, codes: np.ndarray):
        self.least, self.step, self.codes = least, step, codes

    @classmethod
    def encode(cls, values: np.ndarray) -> Quantised:
        least, most = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (most - least) / LEVELS or 1.0
        return cls(least, step, np.rint((values - least) / step).astype("<u2"))

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        return self.least + self.step * self.codes[index]

    def to_bytes(self) -> bytes:
        return struct.pack("<ddq", self.least, self.step, len(self.codes)) + self.codes.tobytes()

    @classmethod
    def view(cls, data: memoryview, at: int) -> tuple[Quantised, int]:
        least, step, n = struct.unpack_from("<ddq", data, at)
        return cls(least, step, np.frombuffer(data, "<u2", n, at + 24)), at + 24 + 2 * n


class Trie:
    """Words with their values alone, and pairs (word, context) with theirs."""

    def __init__(self, data: bytes):
        view, at = memoryview(data), 0
        self.words, at = EliasFano.view(view, at)
        self.pointers, at = EliasFano.view(view, at)
        self.contexts, at = EliasFano.view(view, at)
        self.alone, at = Quantised.view(view, at)
        self.pairs, at = Quantised.view(view, at)

    @staticmethod
    def build(words: np.ndarray, alone: np.ndarray, owners: np.ndarray, contexts: np.ndarray, pairs: np.ndarray) -> bytes:
        """Ascending words with values; pairs by position of the word in *words*, then context."""
        pointers = np.searchsorted(owners, np.arange(len(words) + 1))
        level = (owners.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts.astype(np.uint64)
        return b"".join((EliasFano.encode(words).to_bytes(), EliasFano.encode(pointers).to_bytes(), EliasFano.encode(level).to_bytes(),
                         Quantised.encode(alone).to_bytes(), Quantised.encode(pairs).to_bytes()))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words in level one, and whether they are there."""
        n = self.words.n
        at = self.words.successor(np.zeros(len(words), np.int64), np.full(len(words), n), words)
        safe = np.minimum(at, max(n - 1, 0))
        return safe, (at < n) & (self.words.access(safe) == words) if n else np.zeros(len(words), bool)

    def lookup(self, at: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of a context within the range of the word at *at*, and whether it is there."""
        first, last = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        target = (at.astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts.astype(np.uint64)
        place = self.contexts.successor(first, last, target)
        safe = np.minimum(place, max(self.contexts.n - 1, 0))
        return safe, (place < last) & (self.contexts.access(safe) == target) if self.contexts.n else np.zeros(len(at), bool)
