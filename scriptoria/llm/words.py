"""Hashes of the words of many texts at once, in numpy.

Words are runs without U+0020 and U+0009 to U+000D, with A-Z in lower case; both can be told
from the bytes of UTF-8.  A word's hash is a polynomial of random numbers for its bytes,
modulo 2**64, and a final mix: words of one text and of others get the same hash everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: a bound of memory only.
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _table_of_powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first *n* powers; tables are kept, so that groups of one size share them."""
    return _table_of_powers(int(base), max(CHUNK.bit_length(), int(n).bit_length()))[:n]


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices of *data*."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, max(1, len(data)))[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(starts, text_ends)
    return hash_bytes(data, starts, ends), np.diff(before, prepend=0)


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`word_hashes` of a batch in groups of about CHUNK bytes; null is the empty text."""
    group, size = [], 0
    for t in texts:
        data = t.as_buffer().to_pybytes() if t.is_valid else b""
        if group and size + len(data) > CHUNK:
            yield word_hashes(group)
            group, size = [], 0
        group.append(data)
        size += len(data)
    if group:
        yield word_hashes(group)


def in_parts(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text cut at blanks into parts of about *size* bytes, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        end = text.find(b" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` with the memory of CHUNK bytes, also for long texts without long words."""
    found, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    group, owner, size = [], [], 0

    def flush() -> None:
        hashes, n = word_hashes(group)
        found.append(hashes)
        np.add.at(counts, owner, n)

    for i, text in enumerate(texts):
        for part in in_parts(text):
            if group and size + len(part) > CHUNK:
                flush()
                group, owner, size = [], [], 0
            group.append(part)
            owner.append(i)
            size += len(part)
    if group:
        flush()
    return np.concatenate(found), counts


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row, also over the ends of texts."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i: i + n]
    return mix(out + np.uint64(k))


def shingles(words: np.ndarray, counts: np.ndarray, k: int, order=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes of k words in a row of every text, ascending, and their places in an order.

    A text of fewer words is one shingle.  *order* gives places for (words, shingles, k).
    """
    runs = rolled(words, k)
    places = order(words, runs, k) if order else np.zeros(len(runs), np.float32)
    at = 0
    for count in counts.tolist():
        if count >= k:
            part = slice(at, at + count - k + 1)
            by_hash = np.argsort(runs[part], kind="stable")
            found, place = runs[part][by_hash], places[part][by_hash]
            first = np.append(True, found[1:] != found[:-1])
            yield found[first], place[first]
        elif count:
            whole = np.zeros(1, np.uint64)
            for w in words[at: at + count]:
                whole = whole * _BASE + w
            yield mix(whole + np.uint64(count)), np.zeros(1, np.float32)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.float32)
        at += count
