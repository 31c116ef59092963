"""Pixels of decoded images as spans and sums, one image row at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.scan import spread
from scriptoria.sources.files import with_on_missing

#: Bytes of masks that are worked on together.
TOGETHER = 4 << 20


def _channels(data: memoryview, height: int, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Red, green, blue of rows of B, G, R (A) or gray bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, n).astype(np.int32)
    if n == 1:
        return pixels[..., 0], pixels[..., 0], pixels[..., 0]
    return pixels[..., 2], pixels[..., 1], pixels[..., 0]


def _gray(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (299 * r + 587 * g + 114 * b + 500) // 1000


def _text_and_dont_care(policy: str, r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(r.shape, dtype=bool)
    if policy == "colour_coded":
        return b == 8, r == 128
    if policy == "gray_positive":
        return _gray(r, g, b) > 0, none
    if policy == "any_channel":
        return (r + g + b) > 0, none
    if policy == "above_127":
        return _gray(r, g, b) > 127, none
    raise ValueError(f"unknown mask policy: {policy}")


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x0, x1 of the maximal runs of a mask."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    return y, x0, x1 - 1


def mask_spans(images: DataFrame, policy: str, on_missing: str = "skip") -> DataFrame:
    """Spans (path, kind, y, x0, x1) of the text and don't-care pixels of mask images.

    A mask that cannot be decoded has no spans (skip), ends the job (error), or gives one
    row with nulls (keep).
    """
    _text_and_dont_care(policy, *(np.zeros((1, 1), dtype=np.int32),) * 3)
    readable = F.coalesce((F.col("height") > 0) & (F.length("data") > 0), F.lit(False))
    told = with_on_missing(images.withColumn("data", F.when(readable, F.col("data"))), "data", on_missing, "mask")

    def decode(batches):
        for batch in batches:
            paths, data = batch.column("path"), batch.column("data")
            gone = np.flatnonzero(~data.is_valid().to_numpy(zero_copy_only=False))
            if len(gone):
                yield pa.RecordBatch.from_arrays([paths.take(pa.array(gone)).cast(pa.string()), pa.nulls(len(gone), pa.string()), *[pa.nulls(len(gone), pa.int32())] * 3], names=names)
            alike, size = {}, 0
            heights, widths, channels = (batch.column(c).to_pylist() for c in ("height", "width", "n_channels"))
            for i in np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)).tolist():
                held = data[i].as_buffer()
                if len(held) != heights[i] * widths[i] * channels[i]:
                    raise ValueError(f"mask {paths[i]} has {len(held)} bytes, not {heights[i]} x {widths[i]} x {channels[i]}")
                alike.setdefault((widths[i], channels[i]), []).append((i, heights[i], held))
                size += len(held)
                if size >= TOGETHER:
                    yield from found(alike, paths)
                    alike, size = {}, 0
            yield from found(alike, paths)

    def found(alike, paths):
        # images of one width stand below each other and are worked on together
        for (width, n), images_ in alike.items():
            heights = np.array([h for _, h, _ in images_])
            first = np.cumsum(heights) - heights
            planes = _channels(b"".join(held for *_, held in images_), int(heights.sum()), width, n)
            for kind, mask in zip(("text", "dont_care"), _text_and_dont_care(policy, *planes)):
                y, x0, x1 = runs(mask)
                of = np.searchsorted(first, y, "right") - 1
                numbers = [pa.array(v.astype(np.int32)) for v in (y - first[of], x0, x1)]
                named = paths.take(pa.array(np.array([i for i, *_ in images_], np.int64)[of])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([named, pa.array([kind]).take(pa.array(np.zeros(len(y), np.int64))), *numbers], names=names)

    names = ["path", "kind", "y", "x0", "x1"]
    return told.mapInArrow(decode, "path string, kind string, y int, x0 int, x1 int")


def gray_variance(images: DataFrame) -> DataFrame:
    """Population variance of the gray level of each image: path, variance; 0.0 if it cannot be read."""
    def measure(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                h, w, n, data = (batch.column(c)[i].as_py() for c in ("height", "width", "n_channels", "data"))
                found.append(float(np.var(_gray(*_channels(data, h, w, n)))) if data and h > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.float64())], names=["path", "variance"])

    return images.select("path", "height", "width", "n_channels", "data").mapInArrow(measure, "path string, variance double")


def pixels(images: DataFrame) -> DataFrame:
    """One row per pixel (path, y, x, red, green, blue); for crops and small pages only."""
    def unfold(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, h, w, n, data = (batch.column(c)[i].as_py() for c in ("path", "height", "width", "n_channels", "data"))
                planes = [p.ravel() for p in _channels(data, h, w, n)]
                y, x = np.divmod(np.arange(h * w), w)
                arrays = [pa.array([path] * (h * w), pa.string()), *[pa.array(v.astype(np.int32)) for v in (y, x, *planes)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "y", "x", "red", "green", "blue"])

    return spread(images).mapInArrow(unfold, "path string, y int, x int, red int, green int, blue int").select(
        "path", "y", "x", *[F.col(c) for c in ("red", "green", "blue")]
    )
