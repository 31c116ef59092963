"""Nothing of an input is lost or merged: saturated pixels, close scores, long labels, nested regions, any k."""

import pytest
from pyspark.sql import functions as F

from scriptoria.functions import scalars as S
from scriptoria.operators import lines as L
from scriptoria.operators import memory, metrics, scan
from scriptoria.operators import spans as R
from scriptoria.sources import files, images, page_xml, tables, yolo


def test_saturated_pixels_count(spark):
    df = spark.createDataFrame([(1.0, 1, True), (0.0, 0, True), (1.0, 0, True), (0.5, 1, True)], "prob double, mask int, boundary boolean")
    assert metrics.segmentation_loss(df, F.lit(True)).first().loss > 13.8 / 4
    assert metrics.boundary_loss(df).first().loss > 2 * 13.8 / 4
    assert metrics.pseudo_loss(df).first().loss < 1e-3


def test_close_scores_are_steps_of_their_own(spark):
    df = spark.createDataFrame([(0.90004, 1), (0.90003, 0), (0.5, 1)], "score double, tp int")
    for limit in (1_000_000, 1):
        ap = metrics.average_precision(metrics.precision_recall(df, 2, group_limit=limit), group_limit=limit).first().ap
        assert ap == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_long_label_line(spark):
    n = 1_100_000
    df = spark.createDataFrame([("0 " + "0.5 " * n,)], "line string")
    assert df.select(F.size(yolo.numbers(F.col("line")))).first()[0] == n


def test_repeated_keys_and_both_ways_of_assigning(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    prototypes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, embedding array<double>")
    rows = [sorted(tuple(r) for r in memory.assign_to_prototypes(vectors, prototypes, block=b).collect()) for b in (1, 10)]
    assert [(r[0], r[1]) for r in rows[0]] == [(1, "a"), (1, "b"), (2, "a")]
    assert rows[0] == [(a, b, pytest.approx(c)) for a, b, c in rows[1]]


def test_top_per_group_for_any_k(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("c"), "id")
    got = scan.top_per_group(df, ["c"], [F.col("id").desc()], 2000)
    want = scan.top_per_group(df, ["c"], [F.col("id").desc()], 2000, engine_limit=1 << 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_suppression_in_parts_equals_one_fold(spark):
    boxes = spark.createDataFrame([(1, i, 0, i // 7, 50, i // 7 + 20 + i * 13 % 5) for i in range(300)], "page_id long, pred_idx int, x1 int, y1 int, x2 int, y2 int")
    whole, parts = (sorted(r.pred_idx for r in L.suppress_rows(boxes, fold_rows=n).collect()) for n in (20_000, 16))
    kept = []
    for r in boxes.orderBy("y1", "pred_idx").collect():
        near = [k for k in kept if min(r.y2, k.y2) - max(r.y1, k.y1) > 0.95 * (r.y2 - r.y1 + 1e-6)]
        if not near:
            kept.append(r)
        elif r.y2 - r.y1 > near[0].y2 - near[0].y1:
            kept[kept.index(near[0])] = r
    assert whole == parts == sorted(k.pred_idx for k in kept)


PAGE = """<?xml version="1.0"?>
<pc:PcGts xmlns:pc="http://x/y"><pc:Page imageFilename="a&amp;b.png" imageWidth="10" imageHeight="20"><!-- <pc:TextLine id="no"> -->
<pc:TextRegion id="r1"><pc:Coords points="0,0 1,1"/><pc:TextLine id="l1"><pc:Coords points="0,0 1,1 2,2"/><pc:Baseline points="1,1 2,2"/></pc:TextLine>
<pc:TextRegion id="r2"><pc:TextLine id="l2"><pc:Coords points="3,3 4,4 5,5"/><pc:TextEquiv><pc:Unicode>a &lt; b</pc:Unicode></pc:TextEquiv></pc:TextLine></pc:TextRegion></pc:TextRegion>
<pc:TableRegion id="t"><pc:TextRegion id="r3"><pc:Coords points="5,5 6,6"/><pc:TextLine id="l3"><pc:Coords points="5,5 6,6 7,7"/></pc:TextLine></pc:TextRegion></pc:TableRegion>
<pc:TextRegion id="r4"><pc:TextLine id="l4"><pc:Word><pc:Coords points="7,7"/></pc:Word></pc:TextLine></pc:TextRegion></pc:Page></pc:PcGts>"""


def test_lines_and_regions_at_any_depth(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGE)
    pages = page_xml.read_pages(spark, str(tmp_path))
    assert tuple(pages.select("image", "width", "height").first()) == ("a&b.png", 10, 20)
    assert [r.line_id for r in page_xml.text_lines(pages).orderBy("line_idx").collect()] == ["l1", "l2", "l3"]
    assert [(r.region_idx, r.points[0].x) for r in page_xml.regions(pages).orderBy("region_idx").collect()] == [(0, 0), (2, 5)]


def test_unreadable_masks(spark):
    rows = [("a", 1, 2, 1, bytearray(b"\x00\xff")), ("b", -1, -1, -1, None)]
    df = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary")
    assert {r.path for r in images.mask_spans(df, "gray_positive").collect()} == {"a"}
    assert {r.path for r in images.mask_spans(df, "gray_positive", "keep").collect()} == {"a", "b"}
    with pytest.raises(Exception, match="missing mask"):
        images.mask_spans(df, "gray_positive", "error").collect()
    with pytest.raises(ValueError):
        files.with_on_missing(df, "data", "other")


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text('name,DR,RA\n"a, b.png",0.5,0.25\n')
    row = tables.read_metrics(spark, str(tmp_path), ["DR", "RA", "FM"]).first()
    assert (row.DR, row.RA, row.FM) == (0.5, 0.25, None)


def test_names_sort_piece_by_piece(spark):
    names = ["page10", "page", "page-1", "page 2", "page2", "page1", "1page", "page02x"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    import re

    rule = sorted(names, key=lambda x: ([int(p) if p.isdigit() else p for p in re.split(r"(\d+)", x)], x))
    assert [r.path for r in df.orderBy(S.natural_key(F.col("path")), "path").collect()] == rule


def test_what_leaves_the_page_does_not_exist(spark):
    df = spark.createDataFrame([(1, [(-5, -5), (3, -5), (3, 2), (-5, 2)], 10, 10)], "page_id long, points array<struct<x:int,y:int>>, width int, height int")
    spans = R.fill_polygons(df, bounds=("width", "height"))
    assert sorted((r.y, r.x0, r.x1) for r in spans.collect()) == [(y, 0, 3) for y in range(3)]
    assert all(r.y >= 0 and r.x0 >= 0 for r in R.outline_band(df, ["page_id"], bounds=("width", "height")).collect())
