"""Plans for groups too large for one task give the rows of the plain plans."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptoria.operators import components
from scriptoria.operators import components as C
from scriptoria.operators import lines as L
from scriptoria.operators import matching as M
from scriptoria.operators import memory
from scriptoria.operators.scan import attach_group_values, prefix_scan, row_numbers


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group; values with nulls and ties."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.randrange(40), i, rng.choice([None, rng.randrange(9)])) for i in range(3000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g int, i int, v int").cache()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("by", [["g"], []])
def test_prefix_scan_slices(skewed, by, inclusive):
    running = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("v"))}
    plain = prefix_scan(skewed, by, [F.col("i")], running, inclusive=inclusive, sliced=False)
    cut = prefix_scan(skewed, by, [F.col("i")], running, inclusive=inclusive, sliced=True)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_row_numbers_descending(skewed):
    w = Window.partitionBy("g").orderBy(F.desc("i"))
    want = skewed.withColumn("n", F.row_number().over(w))
    got = row_numbers(skewed, ["g"], [F.col("i").desc()], "n", group_limit=10)
    assert sorted(map(str, want.select("g", "i", "n").collect())) == sorted(map(str, got.select("g", "i", "n").collect()))


def test_attach_group_values(skewed):
    sums = skewed.groupBy("g").agg(F.sum("v").alias("s"))
    want = skewed.join(sums, "g").select("g", "i", "v", "s")
    got = attach_group_values(skewed, sums, ["g"], salts=5).select("g", "i", "v", "s")
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))


def brute_force(overlaps, threshold):
    out = []
    for page in {p for p, _, _, _ in overlaps}:
        used = set()
        for g in sorted({g for p, g, _, _ in overlaps if p == page}):
            best, score = None, 0.0
            for j, s in sorted((j, s) for p, gg, j, s in overlaps if p == page and gg == g):
                if j not in used and s > score:
                    best, score = j, s
            if best is not None and score >= threshold:
                used.add(best)
                out.append((page, g, best))
    return sorted(out)


def contended(seed, pages=12, lines=14):
    rng = random.Random(seed)
    return [
        (p, g, j, rng.choice([0.7, 0.75, 0.8, 0.9, 0.95]))
        for p in range(pages) for g in range(lines) for j in range(lines) if rng.random() < 0.3
    ]


@pytest.mark.parametrize("fold_limit", [10_000, 40, 0])
def test_greedy_match_equals_brute_force(spark, fold_limit):
    rows = contended(5)
    df = spark.createDataFrame(rows, "page_id long, gt_idx int, pred_idx int, iou double")
    got = M.greedy_match(df, 0.75, fold_limit=fold_limit)
    found = sorted((r.page_id, r.gt_idx, r.pred_idx) for r in got.collect())
    assert found == brute_force(rows, 0.75)
    assert len({(p, j) for p, _, j in found}) == len(found)


def test_match_chain_of_displacements(spark):
    """Every line prefers the prediction of the line before it."""
    rows = [(1, 0, 0, 0.9)] + [r for i in range(1, 9) for r in ((1, i, i - 1, 0.95), (1, i, i, 0.8))]
    df = spark.createDataFrame(rows, "page_id long, gt_idx int, pred_idx int, iou double")
    got = sorted((r.page_id, r.gt_idx, r.pred_idx) for r in M.greedy_match(df, 0.75, fold_limit=0).collect())
    assert got == brute_force(rows, 0.75) == [(1, i, i) for i in range(9)]


def loop_suppress(boxes, threshold=0.95):
    kept = []
    for i, y1, y2 in sorted(boxes, key=lambda b: (b[1], b[0])):
        for at, (_, k1, k2) in enumerate(kept):
            if (min(y2, k2) - max(y1, k1)) / (y2 - y1 + 1e-6) > threshold:
                if y2 - y1 > k2 - k1:
                    kept[at] = (i, y1, y2)
                break
        else:
            kept.append((i, y1, y2))
    return sorted(i for i, _, _ in kept)


@pytest.mark.parametrize("group_limit", [10_000, 5])
def test_row_suppression_equals_loop(spark, group_limit):
    rng = random.Random(9)
    pages = {p: [(i, y := rng.randrange(200), y + rng.randrange(1, 40)) for i in range(rng.randrange(1, 40))] for p in range(20)}
    rows = [(p, i, 0, y1, 10, y2) for p, boxes in pages.items() for i, y1, y2 in boxes]
    df = spark.createDataFrame(rows, "page_id long, pred_idx int, x1 int, y1 int, x2 int, y2 int")
    got = {}
    for r in L.suppress_rows(df, group_limit=group_limit).collect():
        got.setdefault(r.page_id, []).append(r.pred_idx)
    assert {p: sorted(v) for p, v in got.items()} == {p: loop_suppress(b) for p, b in pages.items()}


def flood(pixels):
    left, found = set(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        left.discard(start)
        todo = [start]
        while todo:
            y, x = todo.pop()
            found[y, x] = start
            for near in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if near in left:
                    left.discard(near)
                    todo.append(near)
    return found


def test_a_long_chain_of_conflicts(spark):
    # every line wants the next one's first choice more than its own: all shift by one
    n = 5000
    rows = [(1, g, g + d, 0.8 + 0.1 * d) for g in range(n) for d in (0, 1)] + [(1, n, n, 0.99)]
    df = spark.createDataFrame(rows, "page_id long, gt_idx int, pred_idx int, iou double")
    jobs = []
    checkpointed = components.checkpointed
    try:
        components.checkpointed = lambda frame: jobs.append(1) or checkpointed(frame)
        got = {(r.gt_idx, r.pred_idx) for r in M.greedy_match(df, 0.75, fold_limit=10).collect()}
    finally:
        components.checkpointed = checkpointed
    assert got == {(g, g + 1) for g in range(n)} and len(jobs) < 30


@pytest.mark.parametrize(("band_rows", "piece_runs", "batch"), [(8192, 10_000, 10_000), (7, 10_000, 10_000), (8192, 30, 10), (8192, 1, 3), (11, 20, 7)])
def test_components_equal_flood_fill(spark, band_rows, piece_runs, batch):
    from scriptoria.operators.spans import pixels_to_spans, spans_to_pixels

    rng = random.Random(3)
    pages = {p: {(y, x) for y in range(40) for x in range(24) if rng.random() < 0.38} for p in (1, 2, 3)}
    rows = [(p, y, x) for p, px in pages.items() for y, x in px]
    df = spark.createDataFrame(rows, "page_id long, y int, x int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        labelled = C.components(pixels_to_spans(df, ["page_id"]), band_rows=band_rows, piece_runs=piece_runs).cache()
        labelled.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.page_id, r.y, r.x): r.comp for r in spans_to_pixels(labelled).collect()}
    want = {(p, y, x): s[0] * (1 << 31) + s[1] for p, px in pages.items() for (y, x), s in flood(px).items()}
    # The label is the first run of the component; compare the partition and the order of components.
    assert got.keys() == want.keys()
    assert {k: got[k] for k in got} == want


def test_prototypes_in_chunks(spark):
    rng = random.Random(2)
    vec = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    proto = [(c, [rng.gauss(0, 1) for _ in range(6)]) for c in range(20)]
    v = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    p = spark.createDataFrame(proto, "label int, embedding array<float>")
    whole = {r.vec_id: r.cls for r in memory.assign_to_prototypes(v, p).collect()}
    cut = {r.vec_id: r.cls for r in memory._assign_by_chunks(v, p, "label", ["vec_id"], size=7).collect()}
    assert whole == cut and len(whole) == 60
