"""Components of two masks matched page by page."""

import numpy as np
import pytest

from scriptoria.operators import matching as M
from scriptoria.operators import spans as R
from scriptoria.operators.mask_pages import Masks
from tests.test_pages import exchanges, found

PAGES = [(9, 20), (1, 30), (30, 1), (14, 3), (7, 7), (16, 16), (5, 8)]


@pytest.mark.parametrize("name", ["a01_mask_page_score", "j08_component_match"])
def test_masks_move_once(spark, name):
    assert exchanges(spark, name) == (1, 0)


def masks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for page, (w, h) in enumerate(PAGES):
        gt = rng.random((h, w)) < 0.45
        pred = gt ^ (rng.random((h, w)) < 0.08)
        if page == 6:
            gt[:] = False
        rows += [(page, y, [v or None if y % 2 else v for v in gt[y].tolist()], pred[y].tolist()) for y in range(h)]
    # a row that one mask has not, a page without components, a page that is null
    rows += [(3, 40, None, [True, True]), (7, 0, [False, None], []), (None, 0, [True], [True])]
    return spark.createDataFrame(rows, "page_id long, y int, gt array<boolean>, pred array<boolean>")


def spans(rows, side):
    from pyspark.sql import functions as F

    return R.rows_to_spans(rows.select("page_id", "y", F.transform(side, lambda v: F.when(v, 1)).alias("label")), ["page_id"], "label")


@pytest.mark.parametrize("threshold", [0.75, 0.2])
def test_masks_are_matched_as_spans(spark, threshold):
    rows = masks(spark)
    counts, matches = M.component_matches(spans(rows, "gt").filter("page_id is not null"), spans(rows, "pred").filter("page_id is not null"), threshold)
    want, totals = found(matches), found(M.page_totals(counts, matches))
    assert len(want) > 8
    for known in (Masks(rows, 1000), Masks(rows), Masks(rows, page_pixels=100)):
        assert found(known.matches(threshold)) == want
        assert [t for t in found(known.totals(threshold)) if t[0] is not None] == totals


def test_no_pixels(spark):
    none = Masks(masks(spark).limit(0), 5)
    assert none.totals().isEmpty() and none.matches().isEmpty()
