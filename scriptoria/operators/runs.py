"""Runs of pixels worked on by bands of pixel rows: what touches, and closed masks.

A run goes to the band of its row, and to the next band if it lies close enough to count there.  The
runs of whole bands are worked on together in one Arrow step behind one shuffle, so that a run moves
once and a task holds STEP_RUNS of them, or one band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import bands
from scriptoria.operators.scan import spread

BAND_ROWS, STEP_RUNS = 512, 1 << 18


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int = STEP_RUNS) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut again so that no group of *keys* is split, at least *most* rows at once as long as there are some."""
    parts, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append(batch)
        rows += batch.num_rows
        if rows < most or all(parts[0].column(k)[0] == batch.column(k)[-1] for k in keys):
            continue
        held = joined(parts)
        last = np.flatnonzero(starts(held, keys))[-1]
        yield held.slice(0, int(last))
        parts = [held.slice(int(last))]
        rows = parts[0].num_rows
    if parts:
        yield joined(parts)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def numbers(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether a sorted row begins a group of *keys*."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in numbers(batch, *keys)])
    return new


def _banded(spans: DataFrame, reach: int, first: int | None = None) -> DataFrame:
    """A copy of each run for each band within *reach* rows of it, with the band's number; from band *first* on, if given."""
    low, high = F.floor((F.col("y") - reach) / BAND_ROWS).cast("int"), F.floor((F.col("y") + reach) / BAND_ROWS).cast("int")
    near = spans
    if first is not None:
        near, low = spans.filter(high >= first), F.greatest(low, F.lit(first))
    return near.withColumn("_band", F.explode(F.sequence(low, high)))


def _by_bands(banded: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """Runs (page_id, y, x0, x1) that *work* finds, given the rows of some bands and the number of each row's group: group, y, x0 and x1."""
    keys = ["page_id", "_band"]
    ordered = spread(banded, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, keys):
            new = starts(batch, keys)
            of, *found = work(batch, np.cumsum(new) - 1)
            pages = batch.column("page_id").take(pa.array(np.flatnonzero(new)[of]))
            yield pa.RecordBatch.from_arrays([pages, *(pa.array(v.astype(np.int32)) for v in found)], names=["page_id", "y", "x0", "x1"])

    kind = dict(banded.dtypes)["page_id"]
    return ordered.mapInArrow(run, f"page_id {kind}, y int, x0 int, x1 int")


def touching(owner: DataFrame) -> DataFrame:
    """Merged runs of the pixels of an instance map (page_id, inst_id, y, x0, x1) with another instance above, below, left or right."""
    def found(batch: pa.RecordBatch, of: np.ndarray) -> tuple[np.ndarray, ...]:
        band, y, x0, x1 = (v.astype(np.int64) for v in numbers(batch, "_band", "y", "x0", "x1"))
        inst = batch.column("inst_id").to_numpy(zero_copy_only=False)
        at = y - band * BAND_ROWS + 1
        # two more rows keep bands apart, and the rows beside a band are there
        row = of * (BAND_ROWS + 3) + at
        order = np.lexsort((x0, row))
        row, x0, x1 = bands.merged(*bands.touching(row[order], x0[order], x1[order], inst[order]))
        at = row % (BAND_ROWS + 3)
        own = (at >= 1) & (at <= BAND_ROWS)
        group = row[own] // (BAND_ROWS + 3)
        first = band[np.searchsorted(of, group)] * BAND_ROWS
        return group, at[own] - 1 + first, x0[own], x1[own]

    return _by_bands(_banded(owner.select("page_id", "inst_id", "y", "x0", "x1"), 1), found)


def closed(spans: DataFrame, kernel: Sequence[tuple[int, int, int]], size: DataFrame, iterations: int = 1) -> DataFrame:
    """Closing of a mask by the *kernel*'s rows (dy, first dx, last dx), on pages of a size (page_id, width, height); pixels outside never count against it.

    The size of a page goes to its bands as one more row, so that nothing else is joined.
    """
    reach = 2 * iterations * max(abs(dy) for dy, *_ in kernel)
    tall = BAND_ROWS + 2 * reach + 1
    placed = _banded(spans.select("page_id", "y", "x0", "x1", F.lit(False).alias("_size")), reach, 0)
    sizes = size.filter("width > 0 and height > 0").select(
        "page_id", F.lit(0).alias("y"), F.col("width").cast("int").alias("x0"), F.col("height").cast("int").alias("x1"), F.lit(True).alias("_size"),
        F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / BAND_ROWS).cast("int"))).alias("_band"))

    def found(batch: pa.RecordBatch, of: np.ndarray) -> tuple[np.ndarray, ...]:
        band, y, x0, x1 = (v.astype(np.int64) for v in numbers(batch, "_band", "y", "x0", "x1"))
        told = batch.column("_size").to_numpy(zero_copy_only=False)
        n = int(of[-1]) + 1
        width, height, first = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        width[of[told]], height[of[told]], first[of] = x0[told], x1[told], band * BAND_ROWS - reach
        # the rows of the page that a band sees, and the place of the first of them
        low = np.maximum(first, 0)
        seen = np.maximum(np.minimum(first + tall - 1, height) - low, 0)
        group = np.repeat(np.arange(n), seen)
        every = group * tall + (low - first)[group] + np.arange(len(group)) - np.repeat(np.cumsum(seen) - seen, seen)

        def dilated(row, x0, x1):
            parts = []
            for dy, lo, hi in kernel:
                of, to = row // tall, row % tall - dy
                there = (to >= 0) & (to < tall - 1) & (first[of] + to >= 0) & (first[of] + to < height[of])
                of, to = of[there], to[there]
                a, b = np.maximum(x0[there] - hi, 0), np.minimum(x1[there] - lo, width[of] - 1)
                some = a <= b
                parts.append((of[some] * tall + to[some], a[some], b[some]))
            return bands.merged(*(np.concatenate(v) for v in zip(*parts)))

        def gaps(row, x0, x1):
            edge = width[every // tall]
            at, a, b = np.append(row, every), np.append(x0, edge), np.append(x1, edge)
            if not len(at):
                return at, a, b
            order = np.lexsort((a, at))
            at, a, b = at[order], a[order], b[order]
            begin = np.append(True, at[1:] != at[:-1])
            left = np.where(begin, 0, np.append(-1, b[:-1]) + 1)
            some = left < a
            return at[some], left[some], a[some] - 1

        at = y - first[of]
        near = ~told & (at >= 0) & (at < tall - 1) & (height[of] > 0)
        runs = of[near] * tall + at[near], x0[near], x1[near]
        for _ in range(iterations):
            runs = dilated(*runs)
        runs = gaps(*runs)
        for _ in range(iterations):
            runs = dilated(*runs)
        row, x0, x1 = gaps(*runs)
        own = (row % tall >= reach) & (row % tall < reach + BAND_ROWS)
        of = row[own] // tall
        return of, row[own] % tall + first[of], x0[own], x1[own]

    return _by_bands(placed.unionByName(sizes), found)
