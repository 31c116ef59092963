"""Pairing ground-truth with predicted lines and scoring pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators.components import components, connected
from scriptoria.operators.runs import numbers, starts, whole_groups
from scriptoria.operators.scan import spread
from scriptoria.operators.spans import _polygon_rows as fill_rows
from scriptoria.operators.spans import ragged
from scriptoria.session import checkpointed

# Lines of one side a page may have for its matching to run as one row's fold.
FOLD_LIMIT = 1000


# Width and height of the cells of the coarse and of the fine grid.
CELL, FINE_CELL = (2048, 256), (64, 16)
# Which pairs meet: both small in the fine grid, all others in the coarse one.
SMALL_PAIR, SMALL_GT, SMALL_PRED, LARGE_PAIR = range(4)


def _cells(df: DataFrame, large_alone: int, small_alone: int, cell: tuple[int, int], fine: tuple[int, int]) -> DataFrame:
    """Rows at the cells where a box meets others of its size and of the other size.

    *large_alone* and *small_alone* are the kinds of pairs of a large, or small, box of this
    side with one of the other size.
    """
    small = (F.col("x2") - F.col("x1") < fine[0]) & (F.col("y2") - F.col("y1") < fine[1])
    place = lambda kind, wh: F.struct(F.lit(kind).alias("_kind"), F.lit(wh[0]).alias("_w"), F.lit(wh[1]).alias("_h"))
    kinds = F.when(small, F.array(place(SMALL_PAIR, fine), place(small_alone, cell))).otherwise(F.array(place(LARGE_PAIR, cell), place(large_alone, cell)))
    rows = df.withColumn("_at", F.explode(kinds)).select("*", "_at.*").drop("_at")
    across = F.sequence(F.floor(F.col("x1") / F.col("_w")), F.floor(F.col("x2") / F.col("_w")))
    down = F.sequence(F.floor(F.col("y1") / F.col("_h")), F.floor(F.col("y2") / F.col("_h")))
    return rows.withColumn("_cx", F.explode(across)).withColumn("_cy", F.explode(down))


def candidate_pairs(gt: DataFrame, pred: DataFrame, cell: tuple[int, int] = CELL, min_iou: float = 0.0, fine: tuple[int, int] = FINE_CELL) -> DataFrame:
    """Pairs of a ground-truth and a predicted box of one page that overlap.

    Both sides go to the page cells they cover and meet there, so the join key is
    (page, cell), not the page; a pair is kept only in the cell that holds the top
    left corner of its intersection, hence once.  Two boxes smaller than a *fine* cell
    meet in the fine grid, other pairs in the coarse one, so that many small boxes in
    one coarse cell do not all meet.  The overlap test is exact: without it the IoU is
    0.  With *min_iou* boxes whose areas alone rule out that IoU are dropped inside the
    join.

    *gt* has page_id, gt_idx and *pred* page_id, pred_idx, both x1, y1, x2, y2.
    """
    g = _cells(gt.select("page_id", "gt_idx", "x1", "y1", "x2", "y2"), SMALL_PRED, SMALL_GT, cell, fine)
    p = _cells(
        pred.select(
            "page_id", "pred_idx", F.col("x1").alias("px1"), F.col("y1").alias("py1"),
            F.col("x2").alias("px2"), F.col("y2").alias("py2"),
            F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"),
        ),
        SMALL_GT, SMALL_PRED, cell, fine,
    ).drop("x1", "y1", "x2", "y2", "_w", "_h")
    left, top = F.greatest("x1", "px1"), F.greatest("y1", "py1")
    overlap = (left <= F.least("x2", "px2")) & (top <= F.least("y2", "py2"))
    once = (F.floor(left / F.col("_w")) == F.col("_cx")) & (F.floor(top / F.col("_h")) == F.col("_cy"))
    pairs = g.join(p, ["page_id", "_kind", "_cx", "_cy"]).filter(overlap & once)
    if min_iou > 0:
        a, b = _area("x1", "y1", "x2", "y2"), _area("px1", "py1", "px2", "py2")
        pairs = pairs.filter(F.least(a, b) >= F.greatest(a, b) * min_iou)
    return pairs.drop("_kind", "_w", "_h", "_cx", "_cy")


def _area(x1: str, y1: str, x2: str, y2: str) -> Column:
    return (F.col(x2) - F.col(x1) + 1).cast("long") * (F.col(y2) - F.col(y1) + 1)


def box_overlap(pairs: DataFrame) -> DataFrame:
    """Intersection, union and IoU in pixels of closed boxes."""
    inter = (F.least("x2", "px2") - F.greatest("x1", "px1") + 1).cast("long") * (
        F.least("y2", "py2") - F.greatest("y1", "py1") + 1
    )
    union = _area("x1", "y1", "x2", "y2") + _area("px1", "py1", "px2", "py2") - inter
    return pairs.select(
        "page_id", "gt_idx", "pred_idx", inter.alias("inter"), union.alias("union"),
        F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("iou"),
    )


# Pixel rows of an instance that go to a pair as one row.
PIECE_ROWS = 256


def span_pieces(spans: DataFrame, idx: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Instances given as spans, cut at multiples of *piece_rows*: page_id, idx, piece, box, area and arrays of their runs."""
    area = F.sum((F.col("x1") - F.col("x0") + 1).cast("long"))
    rows = spans.select("page_id", idx, F.floor(F.col("y") / piece_rows).cast("int").alias("piece"), "y", "x0", "x1")
    pieces = rows.groupBy("page_id", idx, "piece").agg(
        F.min("x0").alias("bx1"), F.min("y").alias("by1"), F.max("x1").alias("bx2"), F.max("y").alias("by2"), area.alias("area"),
        F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("_runs"))
    box = [F.col(f"b{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return pieces.select("page_id", idx, "piece", *box, "area", *(F.col(f"_runs.{c}").alias(f"run_{c}") for c in ("y", "x0", "x1")))


def box_pieces(boxes: DataFrame, idx: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """:func:`span_pieces` of filled boxes (page_id, idx, closed x1, y1, x2, y2), without a row per pixel row."""
    at = F.explode(F.sequence(F.floor(F.col("y1") / piece_rows).cast("int"), F.floor(F.col("y2") / piece_rows).cast("int")))
    cut = boxes.filter("x1 <= x2 and y1 <= y2").select("page_id", idx, at.alias("piece"), "x1", "x2", "y1", "y2").select(
        "page_id", idx, "piece", "x1", F.greatest("y1", F.col("piece") * piece_rows).alias("y1"), "x2",
        F.least("y2", F.col("piece") * piece_rows + piece_rows - 1).alias("y2"))
    rows = F.sequence("y1", "y2")
    same = lambda c: F.transform(rows, lambda _: F.col(c))
    return cut.select("*", _area("x1", "y1", "x2", "y2").alias("area"), rows.alias("run_y"), same("x1").alias("run_x0"), same("x2").alias("run_x1"))


def span_overlap(gt_spans: DataFrame, pred_spans: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Pixel-exact IoU of instances given as spans (gt_idx / pred_idx, y, x0, x1)."""
    return piece_overlap(span_pieces(gt_spans, "gt_idx"), span_pieces(pred_spans, "pred_idx"), min_iou)


def piece_overlap(gt: DataFrame, pred: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Pixel-exact IoU of instances given as pieces of equal height.

    Pieces meet by their boxes; a pair carries the runs of both to one task, which compares
    them there: no single run is shuffled.  Pieces end at the same rows, so only pieces of
    equal number can share pixels.
    """
    def side(pieces: DataFrame, idx: str) -> tuple[DataFrame, DataFrame]:
        named = pieces.withColumn(idx, F.struct(idx, "piece"))
        return named.select("page_id", idx, "x1", "y1", "x2", "y2"), named

    (g_box, g), (p_box, p) = side(gt, "gt_idx"), side(pred, "pred_idx")
    pairs = candidate_pairs(g_box, p_box).select("page_id", "gt_idx", "pred_idx")
    runs = ("run_y", "run_x0", "run_x1")
    met = pairs.join(g.select("page_id", "gt_idx", *(F.col(c).alias(f"g_{c}") for c in runs)), ["page_id", "gt_idx"]).join(
        p.select("page_id", "pred_idx", *(F.col(c).alias(f"p_{c}") for c in runs)), ["page_id", "pred_idx"])
    met = met.select("page_id", "gt_idx.gt_idx", "pred_idx.pred_idx", *(f"{s}_{c}" for s in "gp" for c in runs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(at, PAIRS_AT_ONCE)
                sides = []
                for s in "gp":
                    of, _, y = ragged(batch.column(f"{s}_run_y"))
                    sides.append((of, *(v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (y, *(batch.column(f"{s}_{c}").flatten() for c in runs[1:])))))
                inter, _ = shared_pixels(*sides, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "gt_idx", "pred_idx")), pa.array(inter)], names=["page_id", "gt_idx", "pred_idx", "inter"])

    schema = met.select("page_id", "gt_idx", "pred_idx", F.lit(0).cast("long").alias("inter")).schema
    shared = met.mapInArrow(compare, schema).filter("inter > 0").groupBy("page_id", "gt_idx", "pred_idx").agg(F.sum("inter").alias("inter"))
    sizes = [d.groupBy("page_id", idx).agg(F.sum("area").alias(name)) for d, idx, name in ((gt, "gt_idx", "g_area"), (pred, "pred_idx", "p_area"))]
    found = shared.join(sizes[0], ["page_id", "gt_idx"]).join(sizes[1], ["page_id", "pred_idx"])
    union = F.col("g_area") + F.col("p_area") - F.col("inter")
    return found.select("page_id", "gt_idx", "pred_idx", "inter", union.alias("union"), (F.col("inter") / union).alias("iou")).filter(F.col("iou") >= min_iou)


def polygon_overlap(gt: DataFrame, pred: DataFrame, size: DataFrame | None = None, min_iou: float = 0.0) -> DataFrame:
    """Pixel-exact IoU of polygons (page_id, gt_idx / pred_idx, points) whose boxes meet; pairs without a common pixel give no row.

    Pairs come from the boxes of the vertices, so nothing is filled for them.  A pair then
    carries both outlines to one task, which fills and compares them there: no pixel row is
    shuffled.  With *size* (page_id, width, height) only pixels on the page count.
    """
    bounds = [] if size is None else ["width", "height"]

    def placed(lines: DataFrame, idx: str) -> DataFrame:
        rows = lines.filter(F.size("points") > 0).select("page_id", idx, F.col("points"))
        if size is not None:
            rows = rows.join(size.select("page_id", *bounds), "page_id")
        return rows

    def boxes(rows: DataFrame, idx: str) -> DataFrame:
        box = G.bounding_box(F.col("points"))
        corners = {c: F.floor(box[c]).cast("int") if c[1] == "1" else F.ceil(box[c]).cast("int") for c in ("x1", "y1", "x2", "y2")}
        if size is not None:
            corners |= {c: F.greatest(v, F.lit(0)) for c, v in corners.items() if c[1] == "1"}
            corners |= {c: F.least(corners[c], F.col(full) - 1) for c, full in (("x2", "width"), ("y2", "height"))}
        return rows.select("page_id", idx, *(v.alias(c) for c, v in corners.items())).filter("x1 <= x2 and y1 <= y2")

    g, p = placed(gt, "gt_idx"), placed(pred, "pred_idx")
    pairs = candidate_pairs(boxes(g, "gt_idx"), boxes(p, "pred_idx")).select("page_id", "gt_idx", "pred_idx")
    outlined = pairs.join(g.withColumnRenamed("points", "_g"), ["page_id", "gt_idx"]).join(
        p.select("page_id", "pred_idx", F.col("points").alias("_p")), ["page_id", "pred_idx"])
    sides = [f(F.col(c)).alias(n) for c, f, n in (("_g", G.xs, "_gx"), ("_g", G.ys, "_gy"), ("_p", G.xs, "_px"), ("_p", G.ys, "_py"))]
    rows = outlined.select("page_id", "gt_idx", "pred_idx", *bounds, *sides)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
                batch = whole.slice(at, PAIRS_AT_ONCE)
                page = [batch.column(c).to_numpy(zero_copy_only=False) for c in bounds]
                a, b = (_filled(batch.column(x), batch.column(y), page) for x, y in (("_gx", "_gy"), ("_px", "_py")))
                inter, union = shared_pixels(a, b, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("page_id", "gt_idx", "pred_idx")), pa.array(inter), pa.array(union)], names=["page_id", "gt_idx", "pred_idx", "inter", "union"])

    schema = rows.select("page_id", "gt_idx", "pred_idx", F.lit(0).cast("long").alias("inter"), F.lit(0).cast("long").alias("union")).schema
    found = spread(rows, "page_id", "gt_idx").mapInArrow(compare, schema).filter("inter > 0").withColumn("iou", F.col("inter") / F.col("union"))
    return found.filter(F.col("iou") >= min_iou)


# Pairs of polygons a task fills together.
PAIRS_AT_ONCE = 2048


def _filled(xs: pa.Array, ys: pa.Array, page: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Spans (row of the batch, y, x0, x1) of outlines, cut to their pages' width and height."""
    offsets = np.append(0, np.cumsum(xs.value_lengths().to_numpy())).astype(np.int64)
    x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for v in (xs, ys))
    p, row, x0, x1 = fill_rows(offsets, x, y)
    if page:
        x0, x1 = np.maximum(x0, 0), np.minimum(x1, page[0][p] - 1)
        on = (row >= 0) & (row < page[1][p]) & (x0 <= x1)
        p, row, x0, x1 = p[on], row[on], x0[on], x1[on]
    return p, row, x0, x1


def shared_pixels(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Common and joint pixels of *n* pairs of masks, as spans (pair, y, x0, x1) in order that do not overlap."""
    area = sum(np.bincount(p, x1 - x0 + 1, n) for p, _, x0, x1 in (a, b)).astype(np.int64)
    if not len(a[0]) or not len(b[0]):
        return np.zeros(n, np.int64), area
    low_y, low_x = (min(int(a[k].min()), int(b[k].min())) for k in (1, 2))
    tall = max(int(a[1].max()), int(b[1].max())) - low_y + 1
    wide = max(int(a[3].max()), int(b[3].max())) - low_x + 2
    line = lambda s: (s[0] * tall + s[1] - low_y) * wide - low_x
    at_a, at_b = line(a), line(b)
    first = np.searchsorted(at_b + b[3], at_a + a[2], "left")
    count = np.maximum(np.searchsorted(at_b + b[2], at_a + a[3], "right") - first, 0)
    i = np.repeat(np.arange(len(count)), count)
    j = np.repeat(first, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    inter = np.bincount(a[0][i], np.minimum(a[3][i], b[3][j]) - np.maximum(a[2][i], b[2][j]) + 1, n).astype(np.int64)
    return inter, area - inter


def greedy_match(
    overlaps: DataFrame,
    threshold: float = 0.75,
    counts: DataFrame | None = None,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """One-to-one matches in ground-truth order: each line takes its best free prediction.

    Ties go to the lower prediction index; a match needs ``iou >= threshold``.
    Dropping weaker pairs first is exact, since an accepted best is the best among
    the accepted.  Ordinary pages are folded in one row each; pages with more than
    *fold_limit* lines on a side (*counts*: page_id, N_gt, N_pred; or that many pairs,
    without it) are matched component by component of competing lines.
    """
    live = overlaps.filter((F.col("iou") >= threshold) & (F.col("iou") > 0)).select("page_id", "gt_idx", "pred_idx", "iou")
    if counts is None:
        sized = live.groupBy("page_id").agg(F.count(F.lit(1)).alias("_rows"))
    else:
        sized = counts.select("page_id", F.greatest("N_gt", "N_pred").alias("_rows"))
    large = sized.filter(F.col("_rows") > fold_limit).select("page_id")
    if large.isEmpty():
        return _fold_match(live)
    # Both branches read the pairs: store them once.
    live, large = checkpointed(live), checkpointed(large)
    folded = _fold_match(live.join(large, "page_id", "left_anti"))
    return folded.unionByName(_match_by_components(live.join(large, "page_id", "left_semi")))


def _fold_match(live: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in live.schema.fields}
    choice = F.struct((-F.col("iou")).alias("cost"), F.col("pred_idx").alias("pred_idx"))
    # These pages are small: one shuffle by page serves both aggregations.
    lines = live.repartition("page_id").groupBy("page_id", "gt_idx").agg(F.array_sort(F.collect_list(choice)).alias("choices"))
    page = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", "choices"))).alias("lines"))
    match = f"array<struct<gt_idx:{kinds['gt_idx']},pred_idx:{kinds['pred_idx']},iou:double>>"

    def step(acc: Column, line: Column) -> Column:
        used = F.transform(acc, lambda m: m["pred_idx"])
        best = F.get(F.filter(line["choices"], lambda c: ~F.array_contains(used, c["pred_idx"])), F.lit(0))
        won = F.struct(line["gt_idx"].alias("gt_idx"), best["pred_idx"].alias("pred_idx"), (-best["cost"]).alias("iou"))
        return F.when(best.isNotNull(), F.concat(acc, F.array(won))).otherwise(acc)

    return page.select(
        "page_id", F.explode(F.aggregate("lines", F.array().cast(match), step)).alias("m")
    ).select("page_id", "m.gt_idx", "m.pred_idx", "m.iou")


def _match_by_components(live: DataFrame) -> DataFrame:
    """The same matching without gathering a page.

    Lines that compete for a prediction, directly or through others, are one component; what
    happens in one does not touch another.  Components are dealt to tasks, whose sorted rows
    stream through a loop that remembers the predictions taken in the component at hand.
    """
    live = checkpointed(live)
    first, second = (F.col("gt_idx").cast("long") * 2).alias("a"), (F.col("pred_idx").cast("long") * 2 + 1).alias("b")
    labels = connected(live.select("page_id", first, second))
    named = live.join(labels.select("page_id", (F.col("node") / 2).cast("long").alias("gt_idx"), "label", F.col("node")).filter("node % 2 = 0").drop("node"), ["page_id", "gt_idx"])
    order = ["page_id", "label", "gt_idx", F.col("iou").desc(), "pred_idx"]
    dealt = spread(named.select("page_id", "gt_idx", "pred_idx", "iou", "label"), "page_id", "label").sortWithinPartitions(*order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component = line = None
        taken: set = set()
        for batch in batches:
            won = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "label", "gt_idx", "pred_idx"))
            for at, (page, label, gt, pred) in enumerate(zip(*columns, strict=True)):
                if (page, label) != component:
                    component, line, taken = (page, label), None, set()
                if gt != line and pred not in taken:
                    line = gt
                    taken.add(pred)
                    won.append(at)
            yield batch.select(["page_id", "gt_idx", "pred_idx", "iou"]).take(pa.array(won, pa.int64()))

    matches = dealt.select("page_id", "gt_idx", "pred_idx", "iou").schema
    return dealt.mapInArrow(fold, matches).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in live.select("page_id", "gt_idx", "pred_idx", "iou").schema))


# Lines of one side up to which all pairs of a page are compared in arrays.
PAGE_LINES = 100


def hits_of_pages(lines: DataFrame, levels: int) -> DataFrame:
    """Scores, hits and times of predictions, matched in score order at IoU 0.50, 0.55 and so on: bit i of hits is a match at level i.

    *lines* has page_id, truth, idx, a closed box x1, y1, x2, y2 and score, of pages with at most
    PAGE_LINES lines on a side or about as many.  A prediction takes the best free line, the first
    one on ties.  Whole pages are matched together, a prediction of each at a time, behind one
    shuffle of the boxes; only counts go on.
    """
    keys, box = ["page_id"], ("x1", "y1", "x2", "y2")
    least = np.array([(50 + 5 * i) / 100.0 for i in range(levels)])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, keys):
            page = np.cumsum(starts(batch, keys)) - 1
            truth, idx, *sides = numbers(batch, "truth", "idx", *box)
            gone = ~batch.column("score").is_valid().to_numpy(zero_copy_only=False)
            score = batch.column("score").to_numpy(zero_copy_only=False).astype(float)
            # highest first: NaN is above all, null below
            kind = np.where(gone, 2, np.where(np.isnan(score), 0, 1))
            order = np.lexsort((idx, np.where(kind == 1, -score, 0), kind, page))
            p, g = order[~truth[order]], order[truth[order]]
            if not len(p):
                continue
            n = int(page[-1]) + 1
            n_g, n_p = np.bincount(page[g], minlength=n), np.bincount(page[p], minlength=n)
            first_g = (np.cumsum(n_g) - n_g)[page[p]]
            turn = np.arange(len(p)) - (np.cumsum(n_p) - n_p)[page[p]]
            many = n_g[page[p]]
            a = np.repeat(np.arange(len(p)), many)
            b = np.repeat(first_g, many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            (px1, py1, px2, py2), (gx1, gy1, gx2, gy2) = ([v[at] for v in sides] for at in (p[a], g[b]))
            across, down = np.minimum(px2, gx2) - np.maximum(px1, gx1), np.minimum(py2, gy2) - np.maximum(py1, gy1)
            area = lambda x1, y1, x2, y2: np.trunc(x2 - x1 + 1.0) * (y2 - y1 + 1)
            inter = np.trunc(across + 1.0) * (down + 1)
            union = area(px1, py1, px2, py2) + area(gx1, gy1, gx2, gy2) - inter
            some = (across >= 0) & (down >= 0) & (union > 0)
            iou = np.divide(inter, union, out=np.zeros(len(a)), where=some)
            some &= iou >= least[0]
            a, b, iou = a[some], b[some], iou[some]
            # pairs by turn, then prediction, best line first
            at = np.lexsort((idx[g[b]], -iou, a, turn[a]))
            a, b, iou = a[at], b[at], iou[at]
            taken, hits = np.zeros((len(g), levels), bool), np.zeros(len(p), np.int64)
            ends = np.flatnonzero(np.append(True, turn[a[1:]] != turn[a[:-1]])) if len(a) else np.zeros(0, np.int64)
            for lo, hi in zip(ends.tolist(), [*ends[1:].tolist(), len(a)]):
                who, line = a[lo:hi], b[lo:hi]
                free = (iou[lo:hi, None] >= least) & ~taken[line]
                begin = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                best = np.minimum.reduceat(np.where(free, np.arange(hi - lo)[:, None], hi - lo), begin)
                of, level = np.nonzero(best < hi - lo)
                taken[line[best[of, level]], level] = True
                np.add.at(hits, who[begin[of]], 1 << level)
            counted = pa.table({"score": batch.column("score").take(pa.array(p)), "hits": hits}).group_by(["score", "hits"]).aggregate([([], "count_all")])
            yield from counted.rename_columns(["score", "hits", "times"]).combine_chunks().to_batches()

    kind = dict(lines.dtypes)["score"]
    return spread(lines, *keys).sortWithinPartitions(*keys).mapInArrow(match, f"score {kind}, hits long, times long")


def unique_match(overlaps: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Matches when instances of a side are disjoint: above 0.5 each has at most one partner."""
    if threshold <= 0.5:
        raise ValueError("partners are unique only above 0.5; use greedy_match")
    return overlaps.filter(F.col("iou") >= threshold).select("page_id", "gt_idx", "pred_idx", "iou")


def component_matches(gt_spans: DataFrame, pred_spans: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Numbers of components of two masks given as spans on each page, and the matches of components."""
    # labelled spans are read for the overlap and for the counts: stored once
    gt = checkpointed(components(gt_spans).withColumnRenamed("comp", "gt_idx"))
    pred = checkpointed(components(pred_spans).withColumnRenamed("comp", "pred_idx"))
    overlaps = span_overlap(gt, pred, min_iou=threshold)
    n_gt, n_pred = (d.select("page_id", c).distinct() for d, c in ((gt, "gt_idx"), (pred, "pred_idx")))
    matches = unique_match(overlaps, threshold) if threshold > 0.5 else greedy_match(overlaps, threshold)
    return line_counts(n_gt, n_pred), matches


def line_counts(gt_lines: DataFrame, pred_lines: DataFrame) -> DataFrame:
    """page_id, N_gt, N_pred of each page that has lines on either side, in one aggregation.

    The small result is stored: the size test of the matching and the page scores read it.
    """
    sides = gt_lines.select("page_id", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred_lines.select("page_id", F.lit(0).alias("g"), F.lit(1).alias("p")))
    return checkpointed(sides.groupBy("page_id").agg(F.sum("g").cast("long").alias("N_gt"), F.sum("p").cast("long").alias("N_pred")))


def page_scores(counts: DataFrame, matches: DataFrame, digits: int = 4) -> DataFrame:
    """DR, RA and FM of each page of *counts* (page_id, N_gt, N_pred)."""
    return score_counts(page_totals(counts, matches), digits)


def page_totals(counts: DataFrame, matches: DataFrame) -> DataFrame:
    """page_id, N_gt, N_pred and the number M of matches of each page of *counts*."""
    found = matches.select("page_id", F.lit(0).cast("long").alias("N_gt"), F.lit(0).cast("long").alias("N_pred"), F.lit(1).alias("M"))
    together = counts.select("page_id", "N_gt", "N_pred", F.lit(0).alias("M")).unionByName(found)
    return together.groupBy("page_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("N_gt", "N_pred", "M")))


def score_counts(totals: DataFrame, digits: int = 4) -> DataFrame:
    """Add DR, RA, FM to rows with N_gt, N_pred, M; all zero when a side is empty."""
    both = (F.col("N_gt") > 0) & (F.col("N_pred") > 0)
    dr = F.when(both, F.col("M") / F.col("N_gt")).otherwise(F.lit(0.0))
    ra = F.when(both, F.col("M") / F.col("N_pred")).otherwise(F.lit(0.0))
    rated = totals.withColumn("_dr", dr).withColumn("_ra", ra)
    fm = F.when(F.col("_dr") + F.col("_ra") > 0, 2 * F.col("_dr") * F.col("_ra") / (F.col("_dr") + F.col("_ra"))).otherwise(F.lit(0.0))
    return rated.select(
        *totals.columns,
        F.bround("_dr", digits).alias("DR"), F.bround("_ra", digits).alias("RA"), F.bround(fm, digits).alias("FM"),
    )


def corpus_score(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted means of the page scores; no rows without pages."""
    pages = F.count(F.lit(1)).alias("pages")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("DR", "RA", "FM")]
    return scores.groupBy(*(by or [])).agg(pages, *means).filter(F.col("pages") > 0)
