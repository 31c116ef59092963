"""Connected components of masks given as spans, and their outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.borders import run_outlines
from scriptoria.operators.runs import numbers, starts, whole_groups
from scriptoria.operators.scan import spread, top_per_group
from scriptoria.session import checkpointed

# Pixel rows a task labels in order; pages up to this height are one band.
BAND_ROWS = 8192
# Runs of a band that are labelled together.
PIECE_RUNS = 2_000_000
_SHIFT = 1 << 31


def label_sorted_spans(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Index of the first span of each span's 8-connected component; input sorted by group, y, x0."""
    n = len(y)
    new_row = np.ones(n, dtype=bool)
    new_row[1:] = (group[1:] != group[:-1]) | (y[1:] != y[:-1])
    row = np.cumsum(new_row) - 1
    first = np.flatnonzero(new_row)
    follows = np.zeros(len(first), dtype=bool)
    follows[:-1] = (group[first[1:]] == group[first[:-1]]) & (y[first[1:]] == y[first[:-1]] + 1)
    wide = int(x1.max()) + 4
    starts, ends = row * wide + x0 + 1, row * wide + x1 + 1
    low = np.searchsorted(ends, (row + 1) * wide + x0, "left")
    high = np.searchsorted(starts, (row + 1) * wide + x1 + 2, "right")
    count = np.where(follows[row], np.maximum(high - low, 0), 0)
    src = np.repeat(np.arange(n), count)
    dst = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    label = np.arange(n)
    while len(src):
        a, b = label[src], label[dst]
        apart = a != b
        if not apart.any():
            break
        a, b, src, dst = a[apart], b[apart], src[apart], dst[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _pieces(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Re-cut sorted batches at ends of groups, and within a group of more than *most* rows at ends of pixel rows.

    With each piece goes whether its first group goes on from the piece before.
    """
    parts, rows, goes_on = [], 0, False
    for batch in batches:
        if batch.empty:
            continue
        parts.append(batch)
        rows += len(batch)
        one_group = (parts[0][keys].iloc[0] == batch[keys].iloc[-1]).all()
        if one_group and rows <= most:
            continue
        batch = pd.concat(parts, ignore_index=True)
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut, inside = int(np.argmax(last)), False
        if rows - cut > most:
            y = batch["y"].to_numpy()
            at = int(np.searchsorted(y[cut:], y[-1])) + cut  # the last pixel row may go on in the next batch
            cut, inside = (at, True) if at > cut else (cut, False)
        if cut:
            yield batch.iloc[:cut], goes_on
            goes_on = inside
        parts, rows = [batch.iloc[cut:]], rows - cut
    if rows:
        yield pd.concat(parts, ignore_index=True), goes_on


def _most_runs(size: DataFrame, band_rows: int) -> DataFrame:
    """Bounds of what :func:`components` counts, from the pages' sizes: a pixel row has a run for two pixels at most."""
    in_row, rows = F.floor((F.col("width") + 1) / 2), F.least(F.col("height"), F.lit(band_rows))
    return size.agg(F.max(rows * in_row).alias("runs"), F.max(F.floor((F.col("height") - 1) / band_rows)).alias("band"), F.sum(F.col("height") * in_row).alias("all"))


def components(spans: DataFrame, band_rows: int = BAND_ROWS, piece_runs: int = PIECE_RUNS, size: DataFrame | None = None) -> DataFrame:
    """Spans (page_id, y, x0, x1) with ``comp``, which orders components by their first pixel.

    Bands of pixel rows are labelled on their own, many pages to an Arrow batch.  A band of
    more than *piece_runs* runs is labelled piece by piece, and only the last pixel row of a
    piece stays for the next.  Labels that meet at the border of two pieces or bands are joined
    afterwards.  Runs are counted first, which reads *spans* once more, unless the *size* of all
    pages (page_id, width, height) tells that none is so large.
    """
    keys = ["page_id", "_band"]
    banded = spans.select("page_id", "y", "x0", "x1", F.floor(F.col("y") / band_rows).alias("_band"))
    sizes = _most_runs(size, band_rows).first() if size is not None else None
    if sizes is None or (sizes["runs"] or 0) > piece_runs or (sizes["band"] or 0) >= 1:
        sizes = banded.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs")).agg(F.max("runs").alias("runs"), F.max("_band").alias("band"), F.sum("runs").alias("all")).first()
    ordered = spread(banded, *keys, rows=sizes["all"] or 0).sortWithinPartitions(*keys, "y", "x0")

    def label(batches):
        row = None  # the last pixel row of the piece before: y, x0, x1, comp
        for pdf, goes_on in _pieces(batches, keys, piece_runs):
            page, band = pdf["page_id"].to_numpy(), pdf["_band"].to_numpy()
            change = np.ones(len(pdf), dtype=bool)
            change[1:] = (page[1:] != page[:-1]) | (band[1:] != band[:-1])
            y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
            root = label_sorted_spans(np.cumsum(change), y, x0, x1)
            comp = y[root] * _SHIFT + x0[root]
            yield pdf[["page_id", "y", "x0", "x1"]].assign(comp=comp, meets=pd.array([pd.NA] * len(pdf), "Int64"))
            if goes_on and row is not None and row[0][0] + 1 == y[0]:
                first = np.flatnonzero((y == y[0]) & (page == page[0]) & (band == band[0]))
                a, b = _touching(row[1], row[2], x0[first], x1[first])
                if len(a):
                    met = np.unique(np.column_stack([row[3][a], comp[first[b]]]), axis=0)
                    yield pd.DataFrame({"page_id": page[0], "y": 0, "x0": 0, "x1": 0, "comp": met[:, 0], "meets": pd.array(met[:, 1], "Int64")})
            last = np.flatnonzero((y == y[-1]) & (page == page[-1]) & (band == band[-1]))
            row = y[last], x0[last], x1[last], comp[last]

    def label_whole(batches):
        for batch in whole_groups(batches, keys):
            y, x0, x1 = (v.astype(np.int64) for v in numbers(batch, "y", "x0", "x1"))
            root = label_sorted_spans(np.cumsum(starts(batch, keys)), y, x0, x1)
            own = batch.select(["page_id", "y", "x0", "x1"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(y[root] * _SHIFT + x0[root])], names=["page_id", "y", "x0", "x1", "comp"])

    if (sizes["runs"] or 0) <= piece_runs and (sizes["band"] or 0) < 1:
        return ordered.mapInArrow(label_whole, "page_id long, y int, x0 int, x1 int, comp long")
    labelled = checkpointed(ordered.mapInPandas(label, "page_id long, y int, x0 int, x1 int, comp long, meets long"))
    return _join_bands(labelled.filter("meets is null").drop("meets"), labelled.filter("meets is not null").select("page_id", F.col("comp").alias("a"), F.col("meets").alias("b")), band_rows)


def _touching(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of two pixel rows, each in order, that touch or meet at a corner."""
    low, high = np.searchsorted(b1, a0 - 1, "left"), np.searchsorted(b0, a1 + 1, "right")
    count = np.maximum(high - low, 0)
    first = np.repeat(np.arange(len(a0)), count)
    return first, np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _join_bands(labelled: DataFrame, met: DataFrame, band_rows: int) -> DataFrame:
    """One label for all that meet: *met* has pairs (page_id, a, b) found inside bands, pairs of bands are found here."""
    above = labelled.filter(F.col("y") % band_rows == band_rows - 1).select(
        "page_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("comp").alias("a")
    )
    below = labelled.filter((F.col("y") % band_rows == 0) & (F.col("y") > 0)).withColumnRenamed("comp", "b")
    touching = above.join(below, ["page_id", "y"]).filter((F.col("a0") <= F.col("x1") + 1) & (F.col("a1") >= F.col("x0") - 1))
    labels = connected(checkpointed(touching.select("page_id", "a", "b").unionByName(met).distinct()))
    renamed = labels.withColumnRenamed("node", "comp")
    return labelled.join(renamed, ["page_id", "comp"], "left").select(
        "page_id", "y", "x0", "x1", F.coalesce("label", "comp").alias("comp")
    )


def connected(edges: DataFrame) -> DataFrame:
    """Least node (label) that each node of stored *edges* (page_id, a, b) is connected with: page_id, node, label.

    Labels are taken from neighbours and then from the nodes they name, so that chains take
    rounds like the logarithm of their length.
    """
    both = edges.unionByName(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.select("page_id", F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), ["page_id", "b"]).groupBy("page_id", F.col("a").alias("node")).agg(
            F.min("label").alias("offer")
        )
        hooked = labels.join(offered, ["page_id", "node"]).select("page_id", "node", "label", F.least("label", "offer").alias("new"))
        target = hooked.select("page_id", F.col("node").alias("new"), F.col("new").alias("further"))
        jumped = checkpointed(
            hooked.join(target, ["page_id", "new"], "left").select(
                "page_id", "node", F.col("label").alias("old"), F.least("new", "further").alias("label")
            )
        )
        labels = jumped.select("page_id", "node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels


def component_stats(labelled: DataFrame) -> DataFrame:
    """left, top, width, height and pixel area of each component."""
    left, top = F.min("x0"), F.min("y")
    return labelled.groupBy("page_id", "comp").agg(
        left.alias("left"), top.alias("top"), (F.max("x1") - left + 1).alias("width"), (F.max("y") - top + 1).alias("height"),
        F.sum((F.col("x1") - F.col("x0") + 1).cast("long")).alias("area"),
    )


def largest_component(stats: DataFrame, by: str = "page_id") -> DataFrame:
    """The component of largest area, the first one on ties."""
    return top_per_group(stats, [by], [F.col("area").desc(), F.col("comp")], 1).drop("rank")


def outlines(labelled: DataFrame) -> DataFrame:
    """Outer outline of each component: page_id, comp, points.  Runs are maximal."""
    return outlined(labelled).select("page_id", "comp", "points")


def outlined(labelled: DataFrame, min_area: int = 0) -> DataFrame:
    """Statistics and outer outline of each component of at least *min_area* pixels: those of :func:`component_stats`, and points.  Runs are maximal.

    Both come from one pass over the sorted runs; what is too small is not traced.
    """
    keys = ["page_id", "comp"]
    ordered = spread(labelled.select("page_id", "comp", "y", "x0", "x1"), *keys).sortWithinPartitions(*keys, "y", "x0")

    def trace(batches):
        for batch in whole_groups(batches, keys):
            new = starts(batch, keys)
            page, comp, y, x0, x1 = numbers(batch, "page_id", "comp", "y", "x0", "x1")
            begin = np.flatnonzero(new)
            area = np.add.reduceat((x1 - x0 + 1).astype(np.int64), begin)
            kept = area >= min_area
            runs = kept[np.cumsum(new) - 1]
            begin, area, top = begin[kept], area[kept], y[begin[kept]]
            if not len(begin):
                continue
            y, x0, x1 = y[runs], x0[runs], x1[runs]
            at = np.flatnonzero(new[runs])
            left, height = np.minimum.reduceat(x0, at), y[np.append(at[1:], len(y)) - 1] - top + 1
            width = np.maximum.reduceat(x1, at) - left + 1
            of, px, py = run_outlines(np.cumsum(new[runs]) - 1, y, x0, x1)
            ends = np.append(0, np.cumsum(np.bincount(of))).astype(np.int32)
            points = pa.StructArray.from_arrays([pa.array(px.astype(np.int32)), pa.array(py.astype(np.int32))], ["x", "y"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(page[begin]), pa.array(comp[begin]), *(pa.array(v.astype(np.int32)) for v in (left, top, width, height)), pa.array(area), pa.ListArray.from_arrays(ends, points)],
                names=["page_id", "comp", "left", "top", "width", "height", "area", "points"])

    return ordered.mapInArrow(trace, "page_id long, comp long, left int, top int, width int, height int, area long, points array<struct<x:int,y:int>>")
