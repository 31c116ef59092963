"""Rectangles cut out of decoded images: tiles, windows and line crops as rows of bytes.

The rectangles of an image are gathered into rows of at most RECTANGLES and join its bytes once
a row: an image is moved once, or once for every thousand of its rectangles, never once a
rectangle.  Cutting is a narrow Arrow step behind that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.operators.components import label_sorted_spans
from scriptoria.operators.borders import run_outlines

#: Rectangles that go with one copy of an image, and bytes of cuts handed on at once.
RECTANGLES, CUT_BYTES = 1000, 8 << 20
_SIDES = ("y0", "x0", "y1", "x1")


def with_rectangles(images: DataFrame, rectangles: DataFrame | Column, key: str) -> DataFrame:
    """*images* (key, height, width, n_channels, data) with an array of rectangles each: struct of all their columns but *key*.

    Rectangles have y0, x0, y1, x1, the ends not included.  A column gives the array of each image
    out of the image's own columns; nothing is joined then.
    """
    if isinstance(rectangles, Column):
        own = images.select(key, "height", "width", "n_channels", "data", rectangles.alias("_all"))
        return own.select(key, "height", "width", "n_channels", "data", F.explode(_parts(F.col("_all"))).alias("_rects"))
    columns = [c for c in rectangles.columns if c != key]
    gathered = rectangles.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_all"))
    dealt = gathered.select(F.col(key).alias("_key"), F.explode(_parts(F.col("_all"))).alias("_rects"))
    return images.select(key, "height", "width", "n_channels", "data").join(dealt, F.col(key) == F.col("_key")).drop("_key")


def _parts(rectangles: Column) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rectangles), F.lit(1)), F.lit(RECTANGLES)), lambda at: F.slice(rectangles, at, RECTANGLES))
    return F.when(F.size(rectangles) > RECTANGLES, many).otherwise(F.array(rectangles))


def _fields(images: DataFrame, rectangles: DataFrame | Column, key: str) -> list[T.StructField]:
    """The columns of the rectangles but *key*."""
    columns = images.select(rectangles).schema[0].dataType.elementType if isinstance(rectangles, Column) else rectangles.schema
    return [f for f in columns.fields if f.name != key]


def pixels_of(data: memoryview, height: int, width: int, n: int) -> np.ndarray:
    """Red, green, blue of an image's rows of gray or B, G, R (A) bytes, as height x width x 3."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, n)
    return np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, 2::-1]


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, np.ndarray, list[dict]]]:
    """Key, pixels and rectangles of each image row; images that cannot be decoded have none."""
    for batch in batches:
        told, images, wanted = [batch.column(c).to_pylist() for c in (key, "height", "width", "n_channels")], batch.column("data"), batch.column("_rects")
        for i in range(batch.num_rows):
            name, h, w, n = (c[i] for c in told)
            data = images[i]
            if data.is_valid and (h or 0) > 0 and len(data.as_buffer()) == h * w * n:
                yield name, pixels_of(data.as_buffer(), h, w, n), wanted[i].as_py()


def cut(images: DataFrame, rectangles: DataFrame | Column, key: str = "path", pad: tuple[int, int] | None = None, as_values: bool = False) -> DataFrame:
    """One row per rectangle: key, the rectangle's columns, cut_height, cut_width and the cut.

    The cut holds rows of R, G, B bytes (``bytes``), or with *as_values* the same as floats in
    0 to 1 (``values``), for a model.  A rectangle is cut down to the image; with *pad* = (height,
    width) zeros fill up what lies beyond, so that all cuts are equally large.  A rectangle with
    nothing on the image, or of an image without bytes, gives no row.
    """
    rects = _fields(images, rectangles, key)
    fields = [images.schema[key], *rects, T.StructField("cut_height", T.IntegerType()), T.StructField("cut_width", T.IntegerType())]
    fields.append(T.StructField("values", T.ArrayType(T.FloatType())) if as_values else T.StructField("bytes", T.BinaryType()))
    schema = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, own, pieces in _pieces(batches, key, (4 if as_values else 1) * (pad[0] * pad[1] * 3 if pad else 0), 4 if as_values else 1):
            if pad:
                pieces = [np.pad(p, ((0, pad[0] - p.shape[0]), (0, pad[1] - p.shape[1]), (0, 0))) for p in pieces]
            values = [(p.ravel() / np.float32(255)).astype(np.float32) if as_values else p.tobytes() for p in pieces]
            sides = [pa.array([p.shape[i] for p in pieces], pa.int32()) for i in (0, 1)]
            yield _batch([names, *map(own.field, (f.name for f in rects)), *sides, pa.array(values, arrow[-1].type)], arrow)

    return with_rectangles(images, rectangles, key).mapInArrow(take, schema)


def _pieces(batches: Iterator[pa.RecordBatch], key: str, least: int = 0, times: int = 1) -> Iterator[tuple[pa.Array, pa.StructArray, list[np.ndarray]]]:
    """Keys, rectangles and pixels of the cuts that lie on an image, some CUT_BYTES at once.

    A cut counts with *times* its bytes, with *least* at least.
    """
    from scriptoria.operators.spans import ragged

    for batch in batches:
        data = batch.column("data")
        h, w, n = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width", "n_channels"))
        told = pc.binary_length(data).fill_null(-1).to_numpy(zero_copy_only=False)
        of, _, rects = ragged(batch.column("_rects"))
        y0, x0, y1, x1 = (rects.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _SIDES)
        y0, x0, y1, x1 = np.maximum(y0, 0), np.maximum(x0, 0), np.minimum(y1, h[of]), np.minimum(x1, w[of])
        on = np.flatnonzero(((h > 0) & (told == h * w * n))[of] & (y0 < y1) & (x0 < x1))
        if not len(on):
            continue
        of, y0, x0, y1, x1 = (v[on] for v in (of, y0, x0, y1, x1))
        names, rects = batch.column(key).take(pa.array(of)), rects.take(pa.array(on))
        part = np.cumsum(np.maximum((y1 - y0) * (x1 - x0) * 3 * times, least)) // CUT_BYTES + np.arange(len(on)) // (4 * RECTANGLES)
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(on)]
        for a, b in zip(edges, edges[1:]):
            pieces, at = [], -1
            for i, *box in zip(*(v[a:b].tolist() for v in (of, y0, x0, y1, x1))):
                if i != at:
                    at, pixels = i, pixels_of(data[i].as_buffer(), *(int(v[i]) for v in (h, w, n)))
                pieces.append(pixels[box[0]:box[2], box[1]:box[3]])
            yield names.slice(a, b - a), rects.slice(a, b - a), pieces


def _batch(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def segment(
    images: DataFrame, rectangles: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], key: str = "page_id",
    least: float = 0.005, most: float = 0.95,
) -> DataFrame:
    """Outline of the largest component that a model finds in each rectangle: key, the rectangle's columns, fg_ratio, points.

    The model takes a crop (height x width x 3 bytes) and gives a mask of that height and width;
    it is made once a task.  Of the mask the largest component stays, the first one on ties.
    Crops where it fills less than *least* or more than *most*, or which have no pixel on the
    image, give no row.  Points are in the image's coordinates.  A crop is as large as a line, so
    nothing of this is shuffled.
    """
    rects = [f for f in rectangles.schema.fields if f.name != key]
    schema = T.StructType([rectangles.schema[key], *rects, T.StructField("fg_ratio", T.DoubleType())])
    point = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
    schema = schema.add("points", T.ArrayType(point))
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = make_model(), [], 0
        for name, pixels, wanted in _rows(batches, key):
            h, w, _ = pixels.shape
            for r in wanted:
                top, left = max(r["y0"], 0), max(r["x0"], 0)
                crop = pixels[top:min(r["y1"], h), left:min(r["x1"], w)]
                if not crop.size:
                    continue
                held.append((name, r, top, left, np.asarray(model(crop)).astype(bool)))
                size += crop.shape[0] * crop.shape[1]
                if len(held) >= RECTANGLES or size >= CUT_BYTES:
                    yield traced(held)
                    held, size = [], 0
        if held:
            yield traced(held)

    def traced(held: list[tuple]) -> pa.RecordBatch:
        # small crops are labelled and traced together
        of, ratio, count, px, py = largest_outlines([mask for *_, mask in held])
        kept = (least <= ratio) & (ratio <= most)
        points = np.repeat(kept, count)
        of, ratio, count, px, py = of[kept], ratio[kept], count[kept], px[points], py[points]
        top, left = (np.array([held[i][k] for i in of], np.int64) for k in (2, 3))
        xy = [pa.array((v + np.repeat(by, count)).astype(np.int32)) for v, by in ((px, left), (py, top))]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.StructArray.from_arrays(xy, ["x", "y"]))
        own = [pa.array([held[i][0] for i in of], arrow.field(0).type), *(pa.array([held[i][1][f.name] for i in of], arrow.field(f.name).type) for f in rects)]
        return pa.RecordBatch.from_arrays([*own, pa.array(ratio), lists], names=arrow.names)

    return with_rectangles(images, rectangles, key).mapInArrow(outline, schema)


def largest_outlines(masks: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the masks that are not empty: number, share that the largest component fills (the first of equal ones), points of its outline, and all their x and y."""
    wide = np.array([m.shape[1] + 1 for m in masks], np.int64)
    area = np.array([m.size for m in masks], np.int64)
    first = np.append(0, np.cumsum([m.shape[0] * (m.shape[1] + 1) for m in masks])).astype(np.int64)
    flat = np.zeros(first[-1] + 1, bool)
    for mask, at in zip(masks, first.tolist()):
        flat[at:at + mask.shape[0] * (mask.shape[1] + 1)].reshape(mask.shape[0], -1)[:, :-1] = mask
    edge = np.diff(flat.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    of = np.searchsorted(first, start, "right") - 1
    y, x0 = np.divmod(start - first[of], wide[of])
    x1 = x0 + stop - start
    if not len(of):
        return of, np.zeros(0), of, of, of
    root = label_sorted_spans(of, y, x0, x1)
    filled = np.bincount(root, x1 - x0 + 1, len(root)).astype(np.int64)
    roots = np.flatnonzero(filled)
    ordered = roots[np.lexsort((roots, -filled[roots], of[roots]))]
    best = ordered[np.append(True, of[ordered[1:]] != of[ordered[:-1]])]
    own = np.isin(root, best)
    comp, px, py = run_outlines(np.searchsorted(best, root[own]), y[own], x0[own], x1[own])
    return of[best], filled[best] / area[of[best]], np.bincount(comp, minlength=len(best)), px, py


def largest_outline(mask: np.ndarray) -> tuple[float, list[tuple[int, int]]] | None:
    """Share of a mask that its largest component fills, and that one's outline; None of an empty mask."""
    _, ratio, _, px, py = largest_outlines([mask])
    return (float(ratio[0]), list(zip(px.tolist(), py.tolist(), strict=True))) if len(ratio) else None


def tile_rectangles(tiles: DataFrame) -> DataFrame:
    """Page tiles as rectangles (y, x stay their names)."""
    return tiles.withColumnsRenamed({"y_start": "y0", "x_start": "x0", "y_end": "y1", "x_end": "x1"})


def window_rectangles(windows: DataFrame) -> DataFrame:
    """Inference windows as rectangles, in what they fill."""
    return windows.withColumn("y1", F.col("y0") + F.col("hy")).withColumn("x1", F.col("x0") + F.col("hx"))


def window_pixels(scored: DataFrame, prob: Column | str, size: int, key: str = "page_id") -> DataFrame:
    """Pixels (page_id, y, x, dy, dx, prob) of scored windows: *prob* is an array of size x size numbers, row by row."""
    rows = scored.select(F.col(key).alias("page_id"), "y0", "x0", "hy", "hx", F.posexplode(F.col(prob) if isinstance(prob, str) else prob).alias("_at", "prob"))
    rows = rows.withColumn("dy", F.floor(F.col("_at") / size).cast("int")).withColumn("dx", F.col("_at") % size)
    inside = rows.filter((F.col("dy") < F.col("hy")) & (F.col("dx") < F.col("hx")))
    return inside.select("page_id", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"), "dy", "dx", "prob")


def crop_rows(images: DataFrame, crops: DataFrame, key: str = "page_id") -> DataFrame:
    """Training rows of line crops: the crop's bytes and, as runs of its own pixels, the line's mask.

    *crops* has key, line_idx, x1, y1, x2, y2 (ends not included) and points inside the crop.
    A crop's mask is filled where its bytes are cut, many together; it is null without a pixel in the crop.
    """
    from scriptoria.operators.spans import filled_lists

    placed = crops.withColumnsRenamed({"x1": "x0", "x2": "x1", "y1": "y0", "y2": "y1"})
    rects = [f for f in placed.schema.fields if f.name not in (key, "points")]
    run = T.StructType([T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")])
    fields = [images.schema[key], *rects, T.StructField("cut_height", T.IntegerType()), T.StructField("cut_width", T.IntegerType())]
    fields += [T.StructField("bytes", T.BinaryType()), T.StructField("mask", T.ArrayType(run))]
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, own, pieces in _pieces(batches, key):
            y0, x0, y1, x1 = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _SIDES)
            sides = [pa.array([p.shape[i] for p in pieces], pa.int32()) for i in (0, 1)]
            masks = filled_lists(own.field("points"), x1 - x0, y1 - y0)
            yield _batch([names, *map(own.field, (f.name for f in rects)), *sides, pa.array([p.tobytes() for p in pieces], pa.binary()), masks], arrow)

    return with_rectangles(images, placed, key).mapInArrow(take, T.StructType(fields))
