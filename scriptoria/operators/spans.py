"""Masks as run-length rows ``span(page_id, inst_id, y, x0, x1)``, closed intervals.

Group keys always contain the pixel row, so a very large page spreads over many
tasks; the number of runs in one row is limited by the page width.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scriptoria.functions import geometry as G
from scriptoria.operators import bands, runs
from scriptoria.operators.scan import spread


def _polygon_rows(offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (polygon, y, x0, x1) of the closed polygons with vertices x, y between offsets.

    A row of a polygon is covered between its crossings with the edges that start
    at or above it, on its flat edges and at its vertices.
    """
    sizes = np.diff(offsets)
    poly = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(len(x)) + 1
    ends = offsets[1:][sizes > 0]
    after[ends - 1] = offsets[:-1][sizes > 0]
    nx, ny = x[after], y[after]

    up = y <= ny
    x_lo, y_lo = np.where(up, x, nx), np.minimum(y, ny)
    run, rise = np.where(up, nx - x, x - nx), np.abs(ny - y)
    e = np.repeat(np.arange(len(x)), rise)
    row = y_lo[e] + np.arange(len(e)) - np.repeat(np.cumsum(rise) - rise, rise)
    numerator = x_lo[e] * rise[e] + (row - y_lo[e]) * run[e]
    order = np.lexsort((numerator / rise[e], row, poly[e]))
    e, row, numerator = e[order], row[order], numerator[order]
    inside_0, inside_1 = -(-numerator[0::2] // rise[e[0::2]]), numerator[1::2] // rise[e[1::2]]

    flat = y == ny
    p = np.concatenate([poly[e[0::2]], poly[flat], poly])
    py = np.concatenate([row[0::2], y[flat], y])
    x0 = np.concatenate([inside_0, np.minimum(x, nx)[flat], x])
    x1 = np.concatenate([inside_1, np.maximum(x, nx)[flat], x])
    real = x0 <= x1
    p, py, x0, x1 = p[real], py[real], x0[real], x1[real]
    order = np.lexsort((x1, x0, py, p))
    p, py, x0, x1 = p[order], py[order], x0[order], x1[order]
    if not len(p):
        return p, py, x0, x1
    new_row = np.ones(len(p), dtype=bool)
    new_row[1:] = (p[1:] != p[:-1]) | (py[1:] != py[:-1])
    # Furthest end so far within a row, by lifting each row above the one before.
    lift = np.cumsum(new_row) * (int(x1.max()) - int(x0.min()) + 2)
    reach = np.maximum.accumulate(x1 + lift) - lift
    start = new_row.copy()
    start[1:] |= x0[1:] > reach[:-1] + 1
    at = np.flatnonzero(start)
    return p[at], py[at], x0[at], np.maximum.reduceat(x1, at)


def within_page(spans: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Spans cut to the page whose size stands in two of their columns; what lies outside does not exist."""
    cut = spans.filter((F.col("y") >= 0) & (F.col("y") < F.col(height)))
    cut = cut.withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("x1", F.least(F.col("x1"), F.col(width) - 1))
    return cut.filter("x0 <= x1")


def fill_polygons(df: DataFrame, points: str = "points", bounds: tuple[str, str] | None = None) -> DataFrame:
    """Polygon rows to spans of the pixels inside or on the outline.

    A narrow transformation over Arrow batches: nothing is shuffled, and the rows of
    many polygons are computed together.  *bounds* names columns with the page's width
    and height, to which spans are cut.
    """
    keep = [c for c in df.columns if c != points]
    rows = df.filter(F.size(points) > 0).select(*keep, G.xs(F.col(points)).alias("_xs"), G.ys(F.col(points)).alias("_ys"))
    step = 1 << 12

    def fill(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                xs, ys = batch.column("_xs"), batch.column("_ys")
                offsets = np.asarray(xs.offsets, dtype=np.int64)
                x = xs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                y = ys.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                p, py, x0, x1 = _polygon_rows(offsets - offsets[0], x, y)
                kept = batch.select(keep).take(pa.array(p))
                numbers = [pa.array(v.astype(np.int32)) for v in (py, x0, x1)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *numbers], names=[*keep, "y", "x0", "x1"])

    schema = rows.select(*keep).schema
    for name in ("y", "x0", "x1"):
        schema = schema.add(name, T.IntegerType())
    filled = rows.mapInArrow(fill, schema)
    return within_page(filled, *bounds) if bounds else filled


def filled_lists(points: pa.ListArray, width: np.ndarray, height: np.ndarray) -> pa.ListArray:
    """Runs (y, x0, x1) in order of each polygon, cut to its width and height; null of one without any."""
    of, _, vertices = ragged(points)
    x, y = (vertices.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy")
    p, y, x0, x1 = _polygon_rows(np.append(0, np.cumsum(np.bincount(of, minlength=len(points)))), x, y)
    x0, x1 = np.maximum(x0, 0), np.minimum(x1, width[p] - 1)
    inside = (y >= 0) & (y < height[p]) & (x0 <= x1)
    runs = pa.StructArray.from_arrays([pa.array(v[inside].astype(np.int32)) for v in (y, x0, x1)], ["y", "x0", "x1"])
    n = np.bincount(p[inside], minlength=len(points))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32), mask=np.append(n == 0, False)), runs)


def box_spans(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Boxes (closed x1,y1,x2,y2) to one span per row."""
    return df.select(*keep, F.explode(F.sequence("y1", "y2")).alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def merge_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the spans of each (keys, y) row as maximal runs."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    distinct = spans.groupBy(*keys, "y", "x0").agg(F.max("x1").alias("x1"))
    marked = distinct.withColumn("_reach", F.max("x1").over(before))
    starts = F.when(F.col("_reach").isNull() | (F.col("x0") > F.col("_reach") + 1), 1).otherwise(0)
    grouped = marked.withColumn("_run", F.sum(starts).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        grouped.groupBy(*keys, "y", "_run")
        .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        .drop("_run")
    )


def pixels_to_spans(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Foreground pixels (keys, y, x) to maximal runs."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return (
        pixels.select(*keys, "y", "x")
        .withColumn("_run", F.col("x") - F.row_number().over(row))
        .groupBy(*keys, "y", "_run")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_run")
    )


def ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and place within its row of each element of *lists*, and the elements."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lists.flatten()


def rows_to_spans(rows: DataFrame, keys: Sequence[str], label: str, name: str | None = None, above: float | None = None) -> DataFrame:
    """Maximal runs of equal labels of pixel rows (keys, y, and an array of labels from x = 0; null is background).

    A narrow Arrow step: a row of pixels is one row, nothing is sorted or shuffled.  *name* keeps a run's label.
    With *above*, labels are numbers, of which those above it are foreground, all alike; NaN is above all, as in SQL.
    """
    keep = [*keys, "y"]

    def find(batches):
        for batch in batches:
            of, x, labels = ragged(batch.column(label))
            inked, value = labels.is_valid().to_numpy(zero_copy_only=False), labels.fill_null(0).to_numpy(zero_copy_only=False)
            if above is not None:
                inked, value = inked & ~(value <= above), inked
            other = np.ones(len(of) + 1, bool)  # whether a pixel differs from the one before it
            other[1:-1] = (of[1:] != of[:-1]) | (inked[1:] != inked[:-1]) | (value[1:] != value[:-1])
            start, stop = np.flatnonzero(other[:-1] & inked), np.flatnonzero(other[1:] & inked)
            found = batch.select(keep).take(pa.array(of[start]))
            named = [labels.take(pa.array(start))] if name else []
            ends = [pa.array(x[at].astype(np.int32)) for at in (start, stop)]
            yield pa.RecordBatch.from_arrays([*found.columns, *named, *ends], names=[*keep, *([name] if name else []), "x0", "x1"])

    schema = rows.select(*keep).schema
    if name:
        schema = schema.add(name, rows.schema[label].dataType.elementType)
    return rows.select(*keep, label).mapInArrow(find, schema.add("x0", T.IntegerType()).add("x1", T.IntegerType()))


def spans_to_pixels(spans: DataFrame) -> DataFrame:
    keep = [c for c in spans.columns if c not in ("x0", "x1")]
    return spans.select(*keep, F.explode(F.sequence("x0", "x1")).alias("x"))


def span_area(x0: str = "x0", x1: str = "x1") -> Column:
    return F.sum((F.col(x1) - F.col(x0) + 1).cast("long"))


def instance_map(spans: DataFrame, cell: int = 1024) -> DataFrame:
    """Which instance owns each pixel when later instances overwrite earlier ones.

    Spans are cut at multiples of *cell*; equal pieces keep their largest instance
    (combined before the shuffle), so the pieces of one cell are limited by
    ``cell * (cell + 1) / 2`` however many instances lie on top of each other.
    Pieces that meet no other pass through; the others go through a sweep along their
    row, which keeps the instances it is inside of in a heap.
    """
    c = F.explode(F.sequence(F.floor(F.col("x0") / cell).cast("int"), F.floor(F.col("x1") / cell).cast("int")))
    cut = spans.select("page_id", "inst_id", "y", "x0", "x1", c.alias("cell")).select(
        "page_id", "y", "cell", "inst_id",
        F.greatest("x0", F.col("cell") * cell).alias("x0"),
        F.least("x1", F.col("cell") * cell + cell - 1).alias("x1"),
    )
    owners = cut.groupBy("page_id", "y", "cell", "x0", "x1").agg(F.max("inst_id").alias("inst_id"))
    row = Window.partitionBy("page_id", "y", "cell").orderBy("x0", "x1")
    marked = owners.select(
        "page_id", "inst_id", "y", "x0", "x1", "cell",
        F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("x0").over(row).alias("_after"),
    )
    meets = (F.coalesce("_before", F.lit(-1)) >= F.col("x0")) | F.coalesce(F.col("_after") <= F.col("x1"), F.lit(False))
    at_edge = (F.col("x0") % cell == 0) | (F.col("x1") % cell == cell - 1)
    columns = ["page_id", "inst_id", "y", "x0", "x1"]
    free = marked.filter(~meets).select(*columns)
    resolved = _visible_pieces(marked.filter(meets)).select(*columns)
    # Only runs cut by a cell border or by another instance can continue in another row.
    joined = merge_spans(free.filter(at_edge).unionByName(resolved), ["page_id", "inst_id"]).select(*columns)
    return free.filter(~at_edge).unionByName(joined)


def polygon_owners(polygons: DataFrame, bounds: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """:func:`instance_map` of filled polygons (page_id, inst_id, points), cut to *bounds* if given.

    Polygons meet by page and band of rows; a band with more than *limit* of them goes by pixel rows.
    """
    size = list(bounds or ())
    rows = polygons.select("page_id", "inst_id", "points", *size)
    gathered = bands.gather(rows, ["page_id"], 0, bounds, limit=limit)
    if gathered is None:
        return instance_map(fill_polygons(rows, bounds=bounds).drop(*size))
    return bands.spans_of(gathered, ["page_id"], bounds, lambda band: bands.owned(band, False), rows.schema["inst_id"].dataType)


def sweep_row(x0: list[int], x1: list[int], inst: list[int]) -> list[tuple[int, int, int]]:
    """Runs (x0, x1, instance) of a row that the largest instance owns; pieces in order of x0.

    The sweep goes from one begin or end to the next with a heap of what it is inside of, so n
    pieces take n log n steps and give at most 2 n runs.
    """
    out: list[tuple[int, int, int]] = []
    active: list[tuple[int, int]] = []
    at, i, n = 0, 0, len(x0)
    while i < n or active:
        if not active:
            at = x0[i]
        while i < n and x0[i] <= at:
            heapq.heappush(active, (-inst[i], x1[i]))
            i += 1
        while active and active[0][1] < at:
            heapq.heappop(active)  # ended behind a larger one
        if not active:
            continue
        top, stop = -active[0][0], active[0][1]
        # pieces that begin inside the owner's run matter only if they are larger
        while i < n and x0[i] <= stop and inst[i] <= top:
            heapq.heappush(active, (-inst[i], x1[i]))
            i += 1
        stop = min(stop, x0[i] - 1) if i < n else stop
        if out and out[-1][2] == top and out[-1][1] + 1 == at:
            out[-1] = out[-1][0], stop, top
        else:
            out.append((at, stop, top))
        at = stop + 1
    return out


def _visible_pieces(pieces: DataFrame) -> DataFrame:
    """Runs of the owners of overlapping pieces, by a sweep along each row of a cell."""
    keys = ["page_id", "y", "cell"]
    ordered = spread(pieces.select(*keys, "x0", "x1", "inst_id"), *keys).sortWithinPartitions(*keys, "x0", "x1")
    schema = T.StructType([pieces.schema[c] for c in ("page_id", "inst_id", "y")])
    for name in ("x0", "x1"):
        schema = schema.add(name, T.IntegerType())

    def sweep(batches):
        parts = []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            if all(parts[0].column(c)[0] == batch.column(c)[-1] for c in keys):
                continue  # still one row
            held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            key = [held.column(c).to_numpy(zero_copy_only=False) for c in keys]
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])])
            yield swept(held.slice(0, int(new[-1])), new)
            parts = [held.slice(int(new[-1]))]  # the last row may go on
        if parts:
            yield swept(pa.Table.from_batches(parts).combine_chunks().to_batches()[0], np.zeros(1, np.int64))

    def swept(rows: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        x0, x1, inst = (rows.column(c).to_pylist() for c in ("x0", "x1", "inst_id"))
        cuts = [*begins[begins < rows.num_rows].tolist(), rows.num_rows]
        found, of = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            runs = sweep_row(x0[a:b], x1[a:b], inst[a:b])
            found += runs
            of += [a] * len(runs)
        kept = rows.take(pa.array(of, pa.int64()))
        start, stop, owner = zip(*found)
        return pa.RecordBatch.from_arrays(
            [kept.column("page_id"), pa.array(owner, rows.column("inst_id").type), kept.column("y"), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
            names=["page_id", "inst_id", "y", "x0", "x1"])

    return ordered.mapInArrow(sweep, schema)


def touching_boundary(owner: DataFrame, wrap_size: tuple[str, str] | None = None) -> DataFrame:
    """Pixels of an instance map with another instance above, below, left or right.

    *owner* has one span per owned run; runs of one pixel row do not overlap.  With
    *wrap_size* = (height column, width column) opposite page edges count as neighbours.

    Along a row, neighbours are runs that follow each other.  Between two rows, all runs of both
    are swept once in order of x: where a run begins, the last run begun in the other row is the
    only one it can lie beside.  No run meets all others of its row.  Without *wrap_size* that is
    done by bands of rows behind one shuffle.
    """
    if not wrap_size:
        return runs.touching(owner)
    extra = list(wrap_size) if wrap_size else []
    a = owner.select("page_id", "inst_id", "y", "x0", "x1", *extra)
    row = Window.partitionBy("page_id", "y").orderBy("x0")
    after = F.lead(F.struct("inst_id", "x0")).over(row)
    beside = a.withColumn("_next", after)
    if wrap_size:
        # the last run of a row goes on with the first one, if they reach the edges
        whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.first(F.struct("inst_id", "x0")).over(whole)
        around = F.when((F.col("x1") == F.col(wrap_size[1]) - 1) & (first["x0"] == 0), F.struct(first["inst_id"].alias("inst_id"), F.col(wrap_size[1]).alias("x0")))
        beside = a.withColumn("_next", F.coalesce(after, around))
    meet = beside.filter((F.col("_next.x0") == F.col("x1") + 1) & (F.col("_next.inst_id") != F.col("inst_id")))
    right = F.pmod(F.col("_next.x0"), F.col(wrap_size[1])) if wrap_size else F.col("_next.x0")
    along = meet.select("page_id", "y", F.explode(F.array(F.col("x1"), right)).alias("x0")).withColumn("x1", F.col("x0"))

    lower_pair = F.col("y") - 1 if not wrap_size else F.pmod(F.col("y") - 1, F.col(wrap_size[0]))
    sides = F.array(F.struct(F.lit(True).alias("upper"), F.col("y").alias("pair")), F.struct(F.lit(False).alias("upper"), lower_pair.alias("pair")))
    both = a.select("page_id", "inst_id", "x0", "x1", "y", F.explode(sides).alias("s")).select("page_id", "inst_id", "x0", "x1", "y", "s.*")
    begun = Window.partitionBy("page_id", "pair").orderBy("x0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda upper: F.last(F.when(F.col("upper") == upper, F.struct("inst_id", "x1", "y")), ignorenulls=True).over(begun)
    swept = both.select("page_id", "pair", "x0", last(True).alias("u"), last(False).alias("l")).dropDuplicates(["page_id", "pair", "x0"])
    stop = F.least("u.x1", "l.x1")
    over = swept.filter((stop >= F.col("x0")) & (F.col("u.inst_id") != F.col("l.inst_id")))
    across = over.select("page_id", F.explode(F.array("u.y", "l.y")).alias("y"), "x0", stop.alias("x1"))
    return merge_spans(along.unionByName(across), ["page_id"])


def boundary_mask(polygons: DataFrame, size: DataFrame, thickness: int = 3, limit: int | None = None) -> DataFrame:
    """Pixels where instances touch, and the band along every outline, as merged spans of each page.

    *polygons* has page_id, inst_id and points; *size* page_id, width and height.  Later
    instances overwrite earlier ones; opposite page edges count as neighbours.  A band of rows
    with more than *limit* polygons goes by pixel rows.
    """
    bounds = ("width", "height")
    placed = polygons.select("page_id", "inst_id", "points").join(size.select("page_id", "width", "height"), "page_id")
    half = thickness // 2
    gathered = bands.gather(placed, ["page_id"], max(half, 1), bounds, wrap=True, limit=limit)
    if gathered is not None:
        def found(band: bands.Band) -> tuple[np.ndarray, ...]:
            row, x0, x1, inst = bands.owned(band, True)
            touch = bands.touching(row, x0, x1, inst, band.width[band.place(row)[0]])
            return bands.merged(*(np.concatenate(v) for v in zip(touch, bands.band_of_edges(band, half))))

        return bands.spans_of(gathered, ["page_id"], bounds, found)
    owner = instance_map(fill_polygons(placed, bounds=bounds).drop(*bounds))
    touching = touching_boundary(owner.join(size.select("page_id", "width", "height"), "page_id"), ("height", "width"))
    band = outline_band(placed, ["page_id"], thickness=thickness, bounds=bounds, limit=limit)
    columns = ["page_id", "y", "x0", "x1"]
    return merge_spans(touching.select(*columns).unionByName(band.select(*columns)), ["page_id"])


def outline_band(df: DataFrame, keys: Sequence[str], points: str = "points", thickness: int = 3, bounds: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Pixels within half the thickness of a polygon's outline, as merged spans; cut to *bounds* if given.

    A band of rows with more than *limit* polygons goes by pixel rows.
    """
    half = thickness // 2
    rows = df.select(*keys, *(bounds or ()), F.col(points).alias("points"))
    gathered = bands.gather(rows, keys, half, bounds, limit=limit)
    if gathered is None:
        return _outline_band_rows(rows, keys, half, bounds)
    return bands.spans_of(gathered, keys, bounds, lambda band: bands.merged(*bands.band_of_edges(band, half)))


def _outline_band_rows(df: DataFrame, keys: Sequence[str], half: int, bounds: tuple[str, str] | None) -> DataFrame:
    """:func:`outline_band` by pixel rows."""
    p = F.col("points")
    size = list(bounds or ())
    edges = df.select(*keys, *size, F.explode(F.zip_with(p, G._rotated(p), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e"))
    lo_y, hi_y = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    rows = edges.withColumn("y", F.explode(F.sequence(lo_y - half, hi_y + half)))
    up = F.col("e.a.y") <= F.col("e.b.y")
    x_lo = F.when(up, F.col("e.a.x")).otherwise(F.col("e.b.x"))
    x_hi = F.when(up, F.col("e.b.x")).otherwise(F.col("e.a.x"))
    rise = (hi_y - lo_y).cast("double")
    at = lambda y: x_lo + (x_hi - x_lo) * (y - lo_y) / F.nullif(rise, F.lit(0.0))
    left_x, right_x = F.least(x_lo, x_hi), F.greatest(x_lo, x_hi)
    # The edge passes through the rows within half of y between these two points.
    u, v = at(F.col("y") - half - 0.5), at(F.col("y") + half + 0.5)
    x0 = F.greatest(left_x, F.coalesce(F.floor(F.least(u, v) + 0.5).cast("int"), left_x))
    x1 = F.least(right_x, F.coalesce(F.floor(F.greatest(u, v) + 0.5).cast("int"), right_x))
    band = rows.select(*keys, *size, "y", (x0 - half).alias("x0"), (x1 + half).alias("x1"))
    if bounds:
        band = within_page(band, *bounds).drop(*size)
    return merge_spans(band, keys)


# --- morphology ------------------------------------------------------------------------


def rect_kernel(width: int, height: int) -> list[tuple[int, int, int]]:
    """Rows ``(dy, first dx, last dx)`` of a rectangle about its anchor (size // 2)."""
    ax, ay = width // 2, height // 2
    return [(i - ay, -ax, width - 1 - ax) for i in range(height)]


def ellipse_kernel(width: int, height: int) -> list[tuple[int, int, int]]:
    """Rows of a filled ellipse inscribed in width x height about its anchor (size // 2)."""
    ax, ay = width // 2, height // 2
    rows = []
    for i in range(height):
        dy = i - ay
        reach = round(ax * ((ay * ay - dy * dy) ** 0.5) / ay) if ay else ax
        first, last = max(ax - reach, 0), min(ax + reach, width - 1)
        rows.append((dy, first - ax, last - ax))
    return rows


def dilate(spans: DataFrame, kernel: Sequence[tuple[int, int, int]], size: DataFrame) -> DataFrame:
    """Pixels p with a foreground pixel at p + offset for some kernel offset, within the page.

    *size* has ``page_id, width, height``.
    """
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dy, lo, hi in kernel])
    grown = (
        spans.join(size.select("page_id", "width", "height"), "page_id")
        .select("page_id", "width", "height", "y", "x0", "x1", F.explode(offsets).alias("k"))
        .select(
            "page_id", "height",
            (F.col("y") - F.col("k.dy")).alias("y"),
            F.greatest(F.col("x0") - F.col("k.hi"), F.lit(0)).alias("x0"),
            F.least(F.col("x1") - F.col("k.lo"), F.col("width") - 1).alias("x1"),
        )
        .filter((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x0") <= F.col("x1")))
    )
    return merge_spans(grown.drop("height"), ["page_id"])


def complement(spans: DataFrame, size: DataFrame) -> DataFrame:
    """Background runs of merged spans within the page."""
    every_row = size.select("page_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    edges = spans.select("page_id", "y", "x0", "x1").unionByName(
        every_row.select("page_id", "y", F.col("width").alias("x0"), F.col("width").alias("x1"))
    )
    row = Window.partitionBy("page_id", "y").orderBy("x0")
    gaps = edges.select(
        "page_id", "y", (F.coalesce(F.lag("x1").over(row), F.lit(-1)) + 1).alias("x0"), (F.col("x0") - 1).alias("x1")
    )
    return gaps.filter(F.col("x0") <= F.col("x1"))


def close_mask(spans: DataFrame, kernel: Sequence[tuple[int, int, int]], size: DataFrame, iterations: int = 1) -> DataFrame:
    """Morphological closing; pixels outside the page never count against it."""
    return runs.closed(spans, kernel, size, iterations)
