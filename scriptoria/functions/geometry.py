"""Polygon and box column functions.

A polygon is ``array<struct<x,y>>``; a box is ``struct<x1,y1,x2,y2>``.
Everything is built from Spark's higher-order functions except the two
recursive or numeric ones, which run per polygon in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What *use* makes of a value that is worked out once, however often *use* names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_fields(row: Column, keep: Callable[[Column], Column]) -> Column:
    """The fields of a struct as columns, without rows that *keep* does not hold for.

    The struct is worked out once: a filter behind a projection would be moved before it and work it out again.
    """
    return F.inline(F.filter(F.array(row), keep))


def split_spaces(text: Column) -> Column:
    """The text trimmed and split at white space; a pattern is only compiled for texts with more than single spaces."""
    return bound(F.trim(text), lambda t: F.when(t.rlike(r"[^\S ]|  "), F.split(t, r"\s+")).otherwise(F.split(t, " ")))


def parse_points(text: Column, number: str = "int", separator: str = r"\s+") -> Column:
    """``"x,y x,y"`` to points."""
    def point(t: Column) -> Column:
        xy = F.split(t, ",")
        return F.struct(xy[0].cast(number).alias("x"), xy[1].cast(number).alias("y"))

    return F.transform(split_spaces(text) if separator == r"\s+" else F.split(F.trim(text), separator), point)


def format_points(points: Column) -> Column:
    """Points to ``"x,y x,y"``."""
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def xs(points: Column) -> Column:
    return F.transform(points, lambda p: p["x"])


def ys(points: Column) -> Column:
    return F.transform(points, lambda p: p["y"])


def bounding_box(points: Column) -> Column:
    return F.struct(
        F.array_min(xs(points)).alias("x1"),
        F.array_min(ys(points)).alias("y1"),
        F.array_max(xs(points)).alias("x2"),
        F.array_max(ys(points)).alias("y2"),
    )


def bounding_xywh(points: Column) -> Column:
    """``[x, y, w, h]`` with ``w = xmax - xmin``."""
    x, y = xs(points), ys(points)
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))


def box_polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2))


def normalised_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Centre and size of a box as fractions of the page."""
    return [
        ((x1 + x2) / 2 / width).alias("cx"),
        ((y1 + y2) / 2 / height).alias("cy"),
        ((x2 - x1) / width).alias("w"),
        ((y2 - y1) / height).alias("h"),
    ]


def denormalised_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corners in pixels of a normalised centre box."""
    return [
        ((cx - w / 2) * width).alias("x1"),
        ((cy - h / 2) * height).alias("y1"),
        ((cx + w / 2) * width).alias("x2"),
        ((cy + h / 2) * height).alias("y2"),
    ]


def flatten_points(points: Column) -> Column:
    """``[x1, y1, x2, y2, ...]``."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def unflatten_points(flat: Column, x_scale: Column | None = None, y_scale: Column | None = None) -> Column:
    """Inverse of :func:`flatten_points`, optionally scaling both axes."""
    sx = F.lit(1) if x_scale is None else x_scale
    sy = F.lit(1) if y_scale is None else y_scale

    def paired(v: Column) -> Column:
        pair = lambda i: F.struct((F.get(v, i * 2) * sx).alias("x"), (F.get(v, i * 2 + 1) * sy).alias("y"))
        return F.when(F.size(v) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), pair))

    return bound(flat, paired)


def _rotated(points: Column) -> Column:
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def _edge_sum(points: Column, term) -> Column:
    return F.aggregate(F.zip_with(points, _rotated(points), term), F.lit(0.0), lambda acc, v: acc + v)


def contour_area(points: Column) -> Column:
    """Shoelace area."""
    term = lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")
    return F.abs(_edge_sum(points, term)) / 2


def perimeter(points: Column) -> Column:
    """Length of the closed outline."""
    term = lambda a, b: F.hypot((a["x"] - b["x"]).cast("double"), (a["y"] - b["y"]).cast("double"))
    return _edge_sum(points, term)


def mean_x(points: Column) -> Column:
    return F.aggregate(xs(points), F.lit(0.0), lambda acc, v: acc + v) / F.size(points)


def mean_y(points: Column) -> Column:
    return F.aggregate(ys(points), F.lit(0.0), lambda acc, v: acc + v) / F.size(points)


def contains_point(points: Column, px: Column, py: Column) -> Column:
    """Whether a point lies inside the polygon or on its outline."""
    edges = F.zip_with(points, _rotated(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on_edge(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        return (
            (cross == 0)
            & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
            & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        )

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > py) != (b["y"] > py)
        return straddles & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0)) + a["x"])

    return F.exists(edges, on_edge) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def baseline_bottom_band(points: Column, band: int = 2) -> Column:
    """Vertices within *band* pixels of the lowest one, from left to right."""
    low = lambda p: F.array_max(ys(p)) - band
    return bound(points, lambda all_: bound(low(all_), lambda least: F.array_sort(F.filter(all_, lambda p: p["y"] >= least))))


def baseline_percentile(points: Column, q: float = 0.9) -> Column:
    """Horizontal line at a percentile of y (linear interpolation, half-even rounding)."""
    ordered = F.array_sort(F.transform(ys(points), lambda y: y.cast("double")))
    rank = (F.size(points) - 1) * F.lit(q)
    low = F.floor(rank).cast("int")
    at_low = F.get(ordered, low)
    at_high = F.coalesce(F.get(ordered, low + 1), at_low)
    y = F.bround(at_low + (at_high - at_low) * (rank - low), 0).cast("int")
    x = xs(points)
    return F.array(
        F.struct(F.array_min(x).alias("x"), y.alias("y")), F.struct(F.array_max(x).alias("x"), y.alias("y"))
    )


def baseline_from_box(x: Column, y: Column, w: Column, h: Column, where: str = "bottom") -> Column:
    """Horizontal line from x to x + w, at the last row of the box or at half its height."""
    if where == "bottom":
        level = y + h - 1
    elif where == "middle":
        level = y + F.floor(h / 2).cast("int")
    else:
        raise ValueError(f"unknown baseline position: {where}")
    return F.array(F.struct(x.alias("x"), level.alias("y")), F.struct((x + w).alias("x"), level.alias("y")))


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = 15) -> Column:
    """Grow a box by *pad* and clip it to the page."""
    return F.struct(
        F.greatest(x1 - pad, F.lit(0)).alias("x1"),
        F.greatest(y1 - pad, F.lit(0)).alias("y1"),
        F.least(x2 + pad, width).alias("x2"),
        F.least(y2 + pad, height).alias("y2"),
    )


def shift(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def flip_horizontal(points: Column, width: Column) -> Column:
    return F.transform(points, lambda p: F.struct((width - 1 - p["x"]).alias("x"), p["y"].alias("y")))


def rotate(points: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """Counter-clockwise on the screen, about (cx, cy), y pointing down."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def turn(p: Column) -> Column:
        dx, dy = p["x"] - cx, p["y"] - cy
        return F.struct((c * dx + s * dy + cx).alias("x"), (c * dy - s * dx + cy).alias("y"))

    return F.transform(points, turn)


def clip_to_crop(points: Column, x0: Column, y0: Column, size: Column) -> Column:
    """Vertices in crop coordinates, clamped to the crop."""
    def move(p: Column) -> Column:
        return F.struct(
            F.least(F.greatest(p["x"] - x0, F.lit(0)), size - 1).alias("x"),
            F.least(F.greatest(p["y"] - y0, F.lit(0)), size - 1).alias("y"),
        )

    return F.transform(points, move)


# --- per-polygon numeric functions, Arrow batches -------------------------------------


def _first_of_largest(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place in the flat array of the first largest value of each slice; slices are not empty."""
    top = np.repeat(np.maximum.reduceat(values, starts), sizes)
    at = np.flatnonzero(values == top)
    return at[np.searchsorted(at, starts)]


def simplify_rings(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    """Which vertices Douglas-Peucker keeps of many closed rings, given one after another.

    The tolerance is a share of each ring's perimeter.  A ring is cut at its two most distant
    vertices; then, level by level, all open pieces of all rings are split at once.  Rings that
    would keep under three vertices keep all.
    """
    keep = np.zeros(len(x), bool)
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes >= 3)
    if not len(full):
        return ~keep
    ring = np.repeat(np.arange(len(sizes)), sizes)
    used = np.flatnonzero(sizes[ring] >= 3)
    after = np.arange(len(x)) + 1
    after[(starts + sizes - 1)[full]] = starts[full]
    length = np.zeros(len(x))
    length[used] = np.hypot(x[used] - x[after[used]], y[used] - y[after[used]])
    n, base = sizes[full], starts[full]
    flat = np.cumsum(n) - n  # of the full rings alone
    tolerance = ratio * np.add.reduceat(length[used], flat)

    def furthest(origin: np.ndarray) -> np.ndarray:
        far = (x[used] - np.repeat(x[origin], n)) ** 2 + (y[used] - np.repeat(y[origin], n)) ** 2
        return used[_first_of_largest(far, flat, n)]

    first = furthest(base)
    second = furthest(first)
    low, high = np.minimum(first, second) - base, np.maximum(first, second) - base
    cut = first != second
    keep[first[cut]] = keep[second[cut]] = True
    which = np.tile(np.flatnonzero(cut), 2)
    start, end = np.concatenate([low[cut], high[cut]]), np.concatenate([high[cut], (low + n)[cut]])
    while True:
        inner = end - start - 1
        some = inner > 0
        which, start, end, inner = which[some], start[some], end[some], inner[some]
        if not len(which):
            break
        piece = np.repeat(np.arange(len(which)), inner)
        begin = np.cumsum(inner) - inner
        at = base[which][piece] + (start[piece] + 1 + np.arange(len(piece)) - begin[piece]) % n[which][piece]
        a, b = base[which] + start % n[which], base[which] + end % n[which]
        dx, dy = (x[b] - x[a])[piece], (y[b] - y[a])[piece]
        ox, oy = x[at] - x[a][piece], y[at] - y[a][piece]
        chord = np.hypot(dx, dy)
        distance = np.where(chord == 0, np.hypot(ox, oy), np.abs(dx * oy - dy * ox) / np.where(chord == 0, 1, chord))
        worst = _first_of_largest(distance, begin, inner)
        split = distance[worst] > tolerance[which]
        keep[at[worst[split]]] = True
        middle = (start + 1 + worst - begin)[split]
        which = np.tile(which[split], 2)
        start, end = np.concatenate([start[split], middle]), np.concatenate([middle, end[split]])
    few = np.bincount(ring, keep, len(sizes)) < 3
    return keep | few[ring]


def simplify_ring(ring: np.ndarray, ratio: float) -> np.ndarray:
    """Douglas-Peucker on one closed ring, tolerance a share of its perimeter."""
    return ring[simplify_rings(np.array([len(ring)]), ring[:, 0], ring[:, 1], ratio)] if len(ring) else ring


def simplify(points: Column, ratio: float) -> Column:
    """Simplified polygon with integer vertices; null when the input has under 3 points."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])))
    def run(batch: pa.Array) -> pa.Array:
        sizes = batch.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        x, y = (pc.struct_field(batch.flatten(), c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        keep = simplify_rings(sizes, x, y, ratio)
        kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        vertices = [pa.array(np.rint(v[keep]).astype(np.int32)) for v in (x, y)]
        ends = np.append(0, np.cumsum(kept)).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(vertices, ["x", "y"]), mask=pa.array(sizes < 3))

    return run(points)


def _cut_levels(rings: list[np.ndarray]) -> np.ndarray:
    """y values between which no two edges of the rings cross."""
    segs = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
    p, d = segs[:, :2], segs[:, 2:] - segs[:, :2]
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = p[None, :, :] - p[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / det
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / det
    hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    rows, _ = np.nonzero(hit)
    return np.unique(np.concatenate([segs[:, 1], p[rows, 1] + t[hit] * d[rows, 1]]))


def _intervals_at(ring: np.ndarray, y: float) -> np.ndarray:
    a, b = ring, np.roll(ring, -1, axis=0)
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[cross], b[cross]
    x = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return np.sort(x).reshape(-1, 2)


def ring_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union by exact area, even-odd interior; 0 without area."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    levels = _cut_levels([a, b])
    inter = area_a = area_b = 0.0
    for low, high in zip(levels[:-1], levels[1:]):
        middle, height = (low + high) / 2, high - low
        ia, ib = _intervals_at(a, middle), _intervals_at(b, middle)
        area_a += height * (ia[:, 1] - ia[:, 0]).sum()
        area_b += height * (ib[:, 1] - ib[:, 0]).sum()
        overlap = np.minimum(ia[:, None, 1], ib[None, :, 1]) - np.maximum(ia[:, None, 0], ib[None, :, 0])
        inter += height * overlap.clip(min=0).sum()
    union = area_a + area_b - inter
    return float(inter / union) if union > 0 else 0.0


#: Numbers that one step of :func:`rings_iou` holds at once in an array.
IOU_CELLS = 1 << 19


def _crossings(x: np.ndarray, y: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Ordered x at which rings (pairs x vertices) cross the levels (pairs x levels), filled up with infinity to an even number."""
    nx, ny = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    x, y, nx, ny = (v[:, None, :] for v in (x, y, nx, ny))
    at = level[:, :, None]
    cross = (y > at) != (ny > at)
    share = np.where(cross, at - y, 0) / np.where(cross, ny - y, 1)
    found = np.sort(np.where(cross, x + share * (nx - x), np.inf), axis=2)
    most = int(cross.sum(axis=2).max(initial=0))
    return found[:, :, :most]


def _ring_pairs_iou(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """:func:`ring_iou` of many pairs whose rings have the same numbers of vertices (pairs x vertices)."""
    px, py = np.hstack([ax, bx]), np.hstack([ay, by])
    dx = np.hstack([np.roll(ax, -1, axis=1), np.roll(bx, -1, axis=1)]) - px
    dy = np.hstack([np.roll(ay, -1, axis=1), np.roll(by, -1, axis=1)]) - py
    i, j = np.triu_indices(px.shape[1], 1)
    det = dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j]
    gx, gy = px[:, j] - px[:, i], py[:, j] - py[:, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (gx * dy[:, j] - gy * dx[:, j]) / det, (gx * dy[:, i] - gy * dx[:, i]) / det
    hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    # levels in order, each once, the others moved behind them
    levels = np.sort(np.hstack([py, np.where(hit, py[:, i] + np.where(hit, t, 0) * dy[:, i], np.inf)]), axis=1)
    again = np.zeros(levels.shape, bool)
    again[:, 1:] = levels[:, 1:] == levels[:, :-1]
    levels[again] = np.inf
    levels.sort(axis=1)
    levels = levels[:, : int(np.isfinite(levels).sum(axis=1).max())]
    low, high = levels[:, :-1], levels[:, 1:]
    used = np.isfinite(high)
    height = np.where(used, high - np.where(used, low, 0), 0.0)
    middle = np.where(used, (np.where(used, low, 0) + np.where(used, high, 0)) / 2, np.inf)
    a, b = _crossings(ax, ay, middle), _crossings(bx, by, middle)

    def area(c: np.ndarray) -> np.ndarray:
        there = np.isfinite(c)
        signed = np.where(there, c, 0.0)
        return (height * (signed[:, :, 1::2] - signed[:, :, 0::2]).sum(axis=2)).sum(axis=1)

    shared = np.zeros(height.shape)
    for k in range(0, a.shape[2], 2):
        for m in range(0, b.shape[2], 2):
            start, stop = np.maximum(a[:, :, k], b[:, :, m]), np.minimum(a[:, :, k + 1], b[:, :, m + 1])
            shared += np.where(start < stop, stop - np.where(np.isfinite(start), start, 0), 0.0)
    inter = (height * shared).sum(axis=1)
    union = area(a) + area(b) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def rings_iou(a_sizes: np.ndarray, ax: np.ndarray, ay: np.ndarray, b_sizes: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """:func:`ring_iou` of many pairs of rings, given one after another: pairs of equally many vertices together."""
    out = np.zeros(len(a_sizes))
    a_start, b_start = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    usable = np.flatnonzero((a_sizes >= 3) & (b_sizes >= 3))
    kinds, of = np.unique(np.column_stack([a_sizes[usable], b_sizes[usable]]), axis=0, return_inverse=True)
    of = of.ravel()
    for kind, (n, m) in enumerate(kinds.tolist()):
        rows = usable[of == kind]
        step = IOU_CELLS // (n + m) ** 2
        if step < 2:  # long outlines: the intervals of one level at a time
            for r in rows.tolist():
                i, j = a_start[r], b_start[r]
                out[r] = ring_iou(np.column_stack([ax[i:i + n], ay[i:i + n]]), np.column_stack([bx[j:j + m], by[j:j + m]]))
            continue
        for first in range(0, len(rows), step):
            some = rows[first:first + step]
            i, j = a_start[some][:, None] + np.arange(n), b_start[some][:, None] + np.arange(m)
            out[some] = _ring_pairs_iou(ax[i], ay[i], bx[j], by[j])
    return out


def polygon_iou(a: Column, b: Column) -> Column:
    """Exact-area IoU of two polygons of a row; self-crossing input counts by the even-odd rule."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        rings = []
        for side in (left, right):
            rings.append(side.value_lengths().fill_null(0).to_numpy().astype(np.int64))
            rings += [pc.struct_field(side.flatten(), c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")]
        return pa.array(rings_iou(*rings))

    return run(a, b)
