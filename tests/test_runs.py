"""Runs worked on by bands of pixel rows give what whole pages give, behind one shuffle."""

import numpy as np
import pytest

from scriptoria.operators import runs
from scriptoria.operators import spans as R

RNG = np.random.default_rng(12)
PAGES = [(9, 1100), (1, 700), (30, 1), (14, runs.BAND_ROWS), (12, runs.BAND_ROWS + 1), (20, 40)]


def shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression"), df._jdf.queryExecution().toString().count("Window")


def test_touching_over_bands(spark):
    rows, expected = [], set()
    for page, (w, h) in enumerate(PAGES):
        owner = RNG.integers(0, 4, (h, w)).repeat(3, axis=1)[:, :w]
        for i in (1, 2, 3):
            rows += [(page, i, int(y) - 3, int(a), int(b)) for y, a, b in zip(*_runs(owner == i))]
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            other = np.zeros((h + 2, w + 2), int)
            other[1:-1, 1:-1] = owner
            other = other[1 + dy:h + 1 + dy, 1 + dx:w + 1 + dx]
            expected |= {(page, int(y) - 3, int(x)) for y, x in zip(*np.nonzero((owner > 0) & (other > 0) & (other != owner)))}
    found = R.touching_boundary(spark.createDataFrame(rows, "page_id long, inst_id int, y int, x0 int, x1 int"))
    got = [(r.page_id, r.y, r.x) for r in R.spans_to_pixels(found).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert shuffles(found) == (1, 0)


@pytest.mark.parametrize("iterations", [1, 3])
def test_closing_over_bands(spark, iterations):
    kernel = R.rect_kernel(5, 4)
    rows, expected = [], set()
    for page, (w, h) in enumerate(PAGES):
        mask = RNG.random((h, w)) < 0.2
        rows += [(page, int(y), int(a), int(b)) for y, a, b in zip(*_runs(mask))]
        for held in (mask, None):
            grown = mask if held is not None else ~grown
            for _ in range(iterations):
                far = 10
                wide = np.pad(grown, far)
                grown = np.logical_or.reduce([wide[far + dy:far + dy + h, far + dx:far + dx + w] for dy, lo, hi in kernel for dx in range(lo, hi + 1)])
        expected |= {(page, int(y), int(x)) for y, x in zip(*np.nonzero(~grown))}
    rows.append((99, 0, 0, 3))  # a page whose size is not known
    size = spark.createDataFrame([(p, *s) for p, s in enumerate(PAGES)] + [(77, 5, 5)], "page_id long, width int, height int")
    found = R.close_mask(spark.createDataFrame(rows, "page_id long, y int, x0 int, x1 int"), kernel, size, iterations)
    got = [(r.page_id, r.y, r.x) for r in R.spans_to_pixels(found).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert shuffles(found) == (1, 0)


def _runs(mask):
    from scriptoria.sources.images import runs as of

    return of(mask)


def test_groups_stay_whole():
    import pyarrow as pa

    values = np.repeat(np.arange(40), RNG.integers(1, 30, 40))
    batch = pa.RecordBatch.from_arrays([pa.array(values)], names=["k"])
    cut = list(runs.whole_groups((batch.slice(i, 7) for i in range(0, len(values), 7)), ["k"], 20))
    assert np.concatenate([c.column("k").to_numpy() for c in cut]).tolist() == values.tolist()
    assert all(a.column("k")[-1] != b.column("k")[0] for a, b in zip(cut, cut[1:])) and len(cut) > 5


def test_lines_of_pixel_rows(spark):
    """Pixel rows give the lines of their pixels, and no pixel is sorted on the way."""
    from pyspark.sql import functions as F

    from scriptoria.plans import evaluate

    rows = [(p, y, (RNG.random(w) ** 9).round(2).tolist()) for p, (w, h) in enumerate(PAGES) for y in range(min(h, 60))]
    rows[3][2][4] = float("nan")
    rows[5][2][2] = 0.5
    df = spark.createDataFrame(rows, "page_id long, y int, prob array<double>")
    size = spark.createDataFrame([(p, w, min(h, 60)) for p, (w, h) in enumerate(PAGES)], "page_id long, width int, height int")
    pixels = df.select("page_id", "y", F.posexplode("prob").alias("x", "prob"))
    found, other = (sorted(map(tuple, f(d, size, 0.5, 5).collect())) for f, d in ((evaluate.lines_from_probability_rows, df), (evaluate.lines_from_probabilities, pixels)))
    assert found == other and len(found) > 10


def test_components_of_known_sizes(spark):
    from scriptoria.operators import components as C

    rows = [(p, int(y), int(a), int(b)) for p, (w, h) in enumerate(PAGES) for y, a, b in zip(*_runs(RNG.random((h, w)) < 0.4))]
    spans = spark.createDataFrame(rows, "page_id long, y int, x0 int, x1 int")
    size = spark.createDataFrame([(p, *s) for p, s in enumerate(PAGES)], "page_id long, width int, height int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = spans.mapInArrow(counted, spans.schema)
    labelled = C.components(watched, size=size).localCheckpoint()
    assert read.value == len(rows)  # runs are not read a second time to be counted
    for known in ({}, {"size": size, "band_rows": 100}, {"size": size, "piece_runs": 50}):
        assert sorted(map(tuple, C.components(spans, **known).collect())) == sorted(map(tuple, labelled.collect()))
    stats = {(r.page_id, r.comp): tuple(r) for r in C.component_stats(labelled).collect()}
    points = {(r.page_id, r.comp): r.points for r in C.outlines(labelled).collect()}
    found = C.outlined(labelled, 9).collect()
    assert {(r.page_id, r.comp): tuple(r[:7]) for r in found} == {k: v for k, v in stats.items() if v[6] >= 9} and found
    assert all(r.points == points[r.page_id, r.comp] for r in found) and points.keys() == stats.keys()
