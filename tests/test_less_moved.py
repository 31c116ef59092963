"""Jobs that move and evaluate no more than they need."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from scriptoria.operators import cuts
from scriptoria.operators import tiles as T

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_tiles_are_cut_where_the_image_is(spark):
    plan = plan_of(E.queries()["r10_tile_bytes"](spark, FOLDER))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_tile_list_is_page_tiles(spark):
    pages = spark.createDataFrame([(1, 16, 9), (2, 1, 30), (3, 8, 8), (4, 7, 1), (5, 0, 4), (6, None, 4)], "page_id int, width int, height int")
    for size, stride, least in ((8, 6, 2), (8, 3, 8), (5, 9, 1)):
        want = T.page_tiles(pages.filter("width > 0"), size, stride, least).drop("width", "height")
        listed = T.tile_list(F.col("width"), F.col("height"), size, stride, least)
        got = pages.select("page_id", F.inline(listed)).withColumnsRenamed({"y0": "y_start", "x0": "x_start", "y1": "y_end", "x1": "x_end"})
        assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_lists_of_rectangles_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(cuts, "RECTANGLES", 3)
    pixels = np.arange(20 * 16 * 3, dtype=np.uint8).tobytes()
    images = spark.createDataFrame([(1, 20, 16, 3, pixels), (2, 3, 16, 3, pixels[:144]), (3, 4, 4, 3, None)], "page_id long, height int, width int, n_channels int, data binary")
    tiles = cuts.tile_rectangles(T.page_tiles(images.select("page_id", "width", "height"), 8, 6, 2).drop("width", "height"))
    want = cuts.cut(images, tiles, "page_id")
    got = cuts.cut(images, T.tile_list(F.col("width"), F.col("height"), 8, 6, 2), "page_id").select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 12


def test_crops_carry_their_masks(spark):
    plan = plan_of(E.queries()["r15_crop_bytes"](spark, FOLDER))
    assert plan.count("MapInArrow") == 2  # images, crops with masks
    images = spark.createDataFrame([(1, 6, 8, 1, bytes(range(48)))], "page_id long, height int, width int, n_channels int, data binary")
    crops = spark.createDataFrame(
        [(1, 0, 1, 1, 5, 5, [(0, 0), (9, 0), (9, 1), (0, 1)]), (1, 1, 0, 0, 4, 4, []), (1, 2, 0, 0, 4, 4, None), (1, 3, 0, 0, 2, 2, [(5, 5), (6, 5), (6, 6)])],
        "page_id long, line_idx int, x1 int, y1 int, x2 int, y2 int, points array<struct<x:int,y:int>>")
    masks = {r.line_idx: r["mask"] and [tuple(m) for m in r["mask"]] for r in cuts.crop_rows(images, crops).collect()}
    assert masks == {0: [(0, 0, 3), (1, 0, 3)], 1: None, 2: None, 3: None}


def test_pages_larger_than_a_block(spark, monkeypatch):
    from scriptoria.checks import cutting
    from scriptoria.samples import Samples

    whole = {r.page_id: (r.height, bytes(r.data)) for r in cutting.grid_images(Samples(spark, FOLDER)).collect()}
    monkeypatch.setattr(cutting, "PAGE_LINES", 3)
    assert whole == {r.page_id: (r.height, bytes(r.data)) for r in cutting.grid_images(Samples(spark, FOLDER)).collect()}


def test_random_crop_without_join(spark):
    df = E.queries()["r13_random_crop"](spark, FOLDER)
    assert "Join" not in plan_of(df)
    from scriptoria.checks.raster import mask_spans
    from scriptoria.operators import spans as R
    from scriptoria.samples import Samples

    s = Samples(spark, FOLDER)
    want = T.crop_spans(mask_spans(s), T.crop_origins(s.grid_size, 8, seed=42), 8).groupBy("page_id").agg(R.span_area().alias("area"))
    assert sorted(df.collect()) == sorted(want.collect())


def test_tasks_of_a_window_follow_the_rows(spark, monkeypatch):
    from scriptoria.operators import scan

    df = spark.range(900).selectExpr("id % 90 as k", "id as v")
    want = sorted(scan.row_numbers(df, ["k"], [F.col("v")], "n").collect())
    monkeypatch.setattr(scan, "TASK_ROWS", 100)
    cut = scan.row_numbers(df, ["k"], [F.col("v")], "n")
    assert cut.rdd.getNumPartitions() == 9 and sorted(cut.collect()) == want
    assert scan.group_sizes(df.limit(0), ["k"]) == (0, 0) and scan.group_sizes(df, ["k"]) == (900, 10)


def test_contains_join_leaves_other_shapes_out(spark, monkeypatch):
    from scriptoria.operators import joins

    texts = spark.createDataFrame([(t,) for t in ("ab_12.png", "xab_12_34", "ab-12", "", "Äb_12é𝄞9", "12ab_12ab_12", None)], "t string")
    names = spark.createDataFrame([(n,) for n in ("ab_12", "12", "b_1", "Äb", "é𝄞9", "", "zz_99", None, "2")], "n string")
    want = sorted((t.t, n.n) for t in texts.collect() for n in names.collect() if t.t and n.n and n.n in t.t)
    for limit in (1000, 2, 0):
        monkeypatch.setattr(joins, "SHAPES", limit)
        joined = joins.contains_join(texts, names, "t", "n")
        assert joined.columns == ["t", "n"] and sorted(map(tuple, joined.collect())) == want
    monkeypatch.setattr(joins, "SHAPES", 1000)
    one = joins.contains_join(texts, names.filter("n = 'ab_12'"), "t", "n")
    assert "translate" in plan_of(one)


def test_texts_are_parsed_once(spark):
    def times(name, what):
        return E.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().count(what)

    assert times("s04_parse_page_xml", "from_xml") == 1
    # trimmed once: split at spaces, or by a pattern, and each point at its comma
    assert times("p05_enough_points", "split(") == times("s04_parse_page_xml", "split(") == 4
    assert times("g05_denormalised", "split(") == 4 and times("s08_read_yolo", "split(") <= 14


def test_split_spaces_is_the_pattern(spark):
    from scriptoria.functions import geometry as G

    texts = ["", " ", "a", " a b ", "a  b", "a\tb", "\ta b\n", "a b c", "a \n b", "a\x0bb c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~F.split(F.trim("t"), r"\s+").eqNullSafe(G.split_spaces(F.col("t")))).count() == 0


def test_fields_of_nothing(spark):
    from scriptoria.functions import geometry as G
    from scriptoria.sources import yolo

    df = spark.createDataFrame([("0 0.5 0.5 0.25 0.5",), ("0 0.1 0.2 0.3 0.4 0.5 0.6",), ("",), ("0 1",), (None,)], "line string")
    polygon, box = yolo.polygon_pixels(F.col("line"), F.lit(10), F.lit(10)), yolo.box_pixels(F.col("line"), F.lit(8), F.lit(8))
    rows = df.select(F.size(polygon).alias("n"), box["x1"].alias("x1"), yolo.label_kind(F.col("line")).alias("kind")).collect()
    assert [r.x1 for r in rows] == [3.0, None, None, None, None] and [r.n for r in rows][1] == 3
    assert [r.kind for r in rows] == ["box", "polygon", "other", "other", "other"]
    kept = df.select(G.kept_fields(F.struct("line"), lambda r: r["line"].isNotNull()))
    assert kept.columns == ["line"] and kept.count() == 4
    none = df.select(F.lit(None).cast("array<struct<x:int,y:int>>").alias("p")).select(F.size(G.baseline_bottom_band(F.col("p"))).alias("n"), G.baseline_bottom_band(F.col("p")).alias("b"))
    assert none.first().b is None


def test_jitter_of_images_moves_no_pixel(spark):
    plan = plan_of(E.queries()["r14_jitter"](spark, FOLDER))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    rng = np.random.default_rng(2)
    shapes = [(3, 5, 3), (1, 1, 1), (4, 2, 4), (0, 7, 3)]
    data = [rng.integers(0, 256, h * w * n, dtype=np.uint8) for h, w, n in shapes]
    rows = [(i, *s, d.tobytes()) for i, (s, d) in enumerate(zip(shapes, data))] + [(9, 2, 2, 3, None)]
    images = spark.createDataFrame(rows, "page_id long, height int, width int, n_channels int, data binary")
    got = {r.page_id: r.data for r in T.jitter_images(images, 1.1, 0.9).collect()}
    assert got[3] == b"" and got[9] is None
    for i, d in enumerate(data[:3]):
        pixels = spark.createDataFrame([(i, k, int(v)) for k, v in enumerate(d)], "page_id long, k int, v int")
        want = T.jitter(pixels, ["v"], F.lit(1.1), F.lit(0.9)).orderBy("k").collect()
        assert list(got[i]) == [r.v for r in want]
