"""Golomb-Rice codes of sorted numbers, in numpy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Remainder bits and code of ascending numbers below *span*.

    Gaps are split at a power of two near their mean: quotients in unary, then remainders.
    """
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    bits = max(0, int(np.log2(max(1.0, span / n))))
    quotient = gaps >> bits
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
    return bits, np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decode(n: int, bits: int, code: bytes) -> np.ndarray:
    """The numbers of :func:`encode`."""
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(code, np.uint8)
    unary = data[: len(data) - (n * bits + 7) // 8]
    ends = np.flatnonzero(np.unpackbits(unary))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(data[len(unary):])[: n * bits].reshape(n, bits).astype(np.int64)
    return np.cumsum((quotient << bits) + (rest << np.arange(bits)).sum(axis=1))
