"""Components of two masks compared and matched page by page, where a page is one row.

A row holds the pixel rows of both masks of an ordinary page; many pages are labelled, compared and
matched together in one narrow Arrow step, so that no run is shuffled.  Pages of more than PAGE_PIXELS
pixels go by runs and pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import components as C
from scriptoria.operators import matching as M
from scriptoria.operators import spans as R
from scriptoria.operators.pages import flat, greedy
from scriptoria.session import checkpointed

# Pixels up to which a page is one row.
PAGE_PIXELS = 1 << 20


class Side:
    """Components of one mask: page, name and pixels of each, and the runs (pixel row, component, x0, x1)."""

    def __init__(self, pixels: pa.ListArray, page: np.ndarray, y: np.ndarray, pages: int):
        of, x, value = R.ragged(pixels)
        inked = value.fill_null(False).to_numpy(zero_copy_only=False)
        edge = np.ones(len(of) + 1, bool)
        edge[1:-1] = (of[1:] != of[:-1]) | (inked[1:] != inked[:-1])
        start, stop = np.flatnonzero(edge[:-1] & inked), np.flatnonzero(edge[1:] & inked)
        self.row, self.x0, self.x1 = of[start], x[start], x[stop]
        at, y = page[self.row], y[self.row]
        root = C.label_sorted_spans(at, y, self.x0, self.x1) if len(at) else np.zeros(0, np.int64)
        first = root == np.arange(len(root))
        self.comp = (np.cumsum(first) - 1)[root]
        self.page, self.name = at[first], y[first] * C._SHIFT + self.x0[first]
        self.area = np.bincount(self.comp, self.x1 - self.x0 + 1, len(self.page)).astype(np.int64)
        self.n = np.bincount(self.page, minlength=pages)


def shared(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of components with common pixels, and how many."""
    if not len(a.row) or not len(b.row):
        return (np.zeros(0, np.int64),) * 3
    wide = int(max(a.x1.max(), b.x1.max())) + 2
    first = np.searchsorted(b.row * wide + b.x1, a.row * wide + a.x0, "left")
    count = np.maximum(np.searchsorted(b.row * wide + b.x0, a.row * wide + a.x1, "right") - first, 0)
    i = np.repeat(np.arange(len(count)), count)
    j = np.repeat(first, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    pair, of = np.unique(a.comp[i] * len(b.page) + b.comp[j], return_inverse=True)
    inter = np.bincount(of, np.minimum(a.x1[i], b.x1[j]) - np.maximum(a.x0[i], b.x0[j]) + 1, len(pair)).astype(np.int64)
    return pair // len(b.page), pair % len(b.page), inter


class Masks:
    """Pixel rows (page_id, y, arrays of booleans gt and pred from x = 0; null is background) of two masks, dealt with by page.

    *most* bounds the pixels of a page, where that is known; else they are counted first.
    """

    def __init__(self, rows: DataFrame, most: int | None = None, page_pixels: int = PAGE_PIXELS):
        self.rows, self.large = rows.select("page_id", "y", "gt", "pred"), None
        if most is None or most > page_pixels:
            # stored: read for the sizes of pages and for the components
            self.rows = checkpointed(self.rows)
            wide = F.greatest(F.coalesce(F.size("gt"), F.lit(0)), F.coalesce(F.size("pred"), F.lit(0)), F.lit(0))
            large = checkpointed(self.rows.groupBy("page_id").agg(F.sum(wide).alias("_n")).filter(F.col("_n") > page_pixels).select(F.col("page_id").alias("_large")))
            if not large.isEmpty():
                here = F.col("page_id").eqNullSafe(F.col("_large"))
                self.large, self.rows = self.rows.join(large, here, "left_semi"), self.rows.join(large, here, "left_anti")

    def _run(self, work, schema: str) -> DataFrame:
        pages = self.rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "gt", "pred"))).alias("rows"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                page, (y, *sides) = flat(batch.column("rows"), "y", "gt", "pred")
                y = y.to_numpy(zero_copy_only=False).astype(np.int64)
                yield work(batch, *(Side(s, page, y, batch.num_rows) for s in sides))

        return pages.mapInArrow(run, schema)

    def _general(self, threshold: float) -> tuple[DataFrame, DataFrame]:
        inked = lambda c: self.large.select("page_id", "y", F.transform(c, lambda v: F.when(v, 1)).alias("label"))
        return M.component_matches(*(R.rows_to_spans(inked(c), ["page_id"], "label") for c in ("gt", "pred")), threshold)

    def matches(self, threshold: float = 0.75) -> DataFrame:
        """page_id, gt_idx, pred_idx, iou of components that are matched one to one; a component is named by its first pixel."""
        def work(batch: pa.RecordBatch, a: Side, b: Side) -> pa.RecordBatch:
            i, j, iou = matched(batch, a, b, threshold)
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id").take(pa.array(a.page[i])), pa.array(a.name[i]), pa.array(b.name[j]), pa.array(iou)], names=["page_id", "gt_idx", "pred_idx", "iou"])

        found = self._run(work, f"page_id {dict(self.rows.dtypes)['page_id']}, gt_idx long, pred_idx long, iou double")
        return found if self.large is None else found.unionByName(self._general(threshold)[1])

    def totals(self, threshold: float = 0.75) -> DataFrame:
        """page_id, N_gt, N_pred, M of each page that has components in either mask."""
        def work(batch: pa.RecordBatch, a: Side, b: Side) -> pa.RecordBatch:
            i, _, _ = matched(batch, a, b, threshold)
            m = np.bincount(a.page[i], minlength=batch.num_rows)
            some = pa.array(a.n + b.n > 0)
            columns = [batch.column("page_id"), *(pa.array(v.astype(np.int64)) for v in (a.n, b.n, m))]
            return pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=["page_id", "N_gt", "N_pred", "M"])

        found = self._run(work, f"page_id {dict(self.rows.dtypes)['page_id']}, N_gt long, N_pred long, M long")
        return found if self.large is None else found.unionByName(M.page_totals(*self._general(threshold)))


def matched(batch: pa.RecordBatch, a: Side, b: Side, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched components of both sides and their IoU: in order, each with its best free partner."""
    i, j, inter = shared(a, b)
    iou = inter / (a.area[i] + b.area[j] - inter)
    some = (iou >= threshold) & batch.column("page_id").is_valid().to_numpy(zero_copy_only=False)[a.page[i]]
    i, j, iou = i[some], j[some], iou[some]
    if threshold <= 0.5:  # above, a component has one partner at most
        page = a.page[i]
        won = greedy(page, i, j, iou, i - (np.cumsum(a.n) - a.n)[page], len(b.page))
        i, j, iou = i[won], j[won], iou[won]
    return i, j, iou
