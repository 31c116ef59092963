"""Cuts of images, blended windows and exported documents against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import cuts, tiles
from scriptoria.plans import predict
from scriptoria.sources import page_xml

RNG = np.random.default_rng(8)
SIZES = {1: (13, 21, 3), 2: (8, 8, 1), 3: (5, 30, 4), 4: (40, 9, 3)}
IMAGES = {p: RNG.integers(0, 256, s, dtype=np.uint8) for p, s in SIZES.items()}


def rgb(p):
    return np.repeat(IMAGES[p], 3, axis=2) if IMAGES[p].shape[2] == 1 else IMAGES[p][:, :, 2::-1]


@pytest.fixture(scope="module")
def images(spark):
    rows = [(p, *m.shape, m.tobytes()) for p, m in IMAGES.items()]
    rows += [(5, 4, 4, 3, None), (6, -1, -1, -1, b""), (7, 4, 4, 3, b"short")]
    return spark.createDataFrame(rows, "page_id long, height int, width int, n_channels int, data binary")


@pytest.mark.parametrize("chunk", [1000, 3])
def test_every_rectangle(spark, images, monkeypatch, chunk):
    monkeypatch.setattr(cuts, "RECTANGLES", chunk)
    monkeypatch.setattr(cuts, "CUT_BYTES", 500)
    rects = [(int(p), i, *sorted(RNG.integers(-4, 45, 2).tolist()), *sorted(RNG.integers(-4, 35, 2).tolist())) for i, p in enumerate(RNG.integers(1, 9, 60))]
    df = spark.createDataFrame(rects, "page_id long, name int, y0 int, y1 int, x0 int, x1 int")
    got = {r.name: (r.cut_height, r.cut_width, bytes(r.bytes)) for r in cuts.cut(images, df, "page_id").collect()}
    want = {}
    for p, name, y0, y1, x0, x1 in rects:
        if p in IMAGES and (part := rgb(p)[max(y0, 0):max(y1, 0), max(x0, 0):max(x1, 0)]).size:
            want[name] = (*part.shape[:2], part.tobytes())
    assert got == want
    padded = {r.name: np.array(r["values"], np.float32) for r in cuts.cut(images, df, "page_id", pad=(60, 50), as_values=True).collect()}
    for name, (h, w, data) in want.items():
        full = np.zeros((60, 50, 3), np.uint8)
        full[:h, :w] = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        assert np.array_equal(np.rint(padded[name] * 255).astype(np.uint8), full.ravel())


def test_no_rectangles_or_images(spark, images):
    none = spark.createDataFrame([], "page_id long, name int, y0 int, y1 int, x0 int, x1 int")
    assert cuts.cut(images, none, "page_id").count() == 0
    assert cuts.cut(images.limit(0), none, "page_id").columns == ["page_id", "name", "y0", "y1", "x0", "x1", "cut_height", "cut_width", "bytes"]


def make_model():
    def model(windows):
        light = windows.reshape(len(windows), 64, 3).mean(axis=2)
        return (light * light.max(axis=1, keepdims=True)).astype(np.float32)

    return model


def starts(full):
    at = list(range(0, max(full - 8, 0) + 1, 4))
    return at + [full - 8] if full > 8 and at[-1] + 8 < full else at


def test_blended_probabilities_equal_a_plain_loop(spark, images):
    got = {(r.page_id, r.y, r.x): r.prob for r in predict.blended_probabilities(images.filter("page_id < 5"), make_model, size=8, stride=4, batch_size=3).collect()}
    axis = np.linspace(-1, 1, 8)
    bell = np.exp(-(axis[:, None] ** 2 + axis[None, :] ** 2) / 0.5)
    for p in IMAGES:
        picture = rgb(p).astype(np.float32) / 255
        h, w, _ = picture.shape
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        for y in starts(h):
            for x in starts(w):
                window = np.zeros((8, 8, 3), np.float32)
                part = picture[y:y + 8, x:x + 8]
                window[:part.shape[0], :part.shape[1]] = part
                out = make_model()(window.reshape(1, -1)).reshape(8, 8)[:part.shape[0], :part.shape[1]]
                total[y:y + 8, x:x + 8] += out * bell[:part.shape[0], :part.shape[1]]
                weight[y:y + 8, x:x + 8] += bell[:part.shape[0], :part.shape[1]]
        for (y, x), value in np.ndenumerate(total / np.maximum(weight, 1e-6)):
            assert abs(got.pop((p, y, x)) - value) < 1e-5
    assert not got


def test_boxes_to_documents_and_back(spark, tmp_path):
    page = np.zeros((120, 200, 3), np.uint8)
    page[10:20, 20:150] = 255  # a line
    page[12:14, 160:164] = 255  # a spot beside it, in the same box
    page[50:52, 30:90] = 255
    page[80, 40:90] = 255  # too thin for an outline
    images = spark.createDataFrame([(1, 120, 200, 3, page.tobytes()), (2, 120, 200, 3, page.tobytes())], "page_id long, height int, width int, n_channels int, data binary")
    boxes = [(1, 0, 10, 5, 190, 25, 0.9), (1, 1, 10, 6, 190, 25, 0.8), (1, 2, 20, 76, 100, 90, 0.9), (1, 3, 20, 45, 100, 60, 0.5), (1, 4, 0, 100, 50, 110, 0.9),
             (1, 5, 20, 45, 100, 60, 0.49), (1, 6, 30, 50, 90, 52, 0.99), (2, 0, 180, 0, 199, 30, 0.9), (2, 1, 500, 500, 600, 600, 0.9)]
    table = spark.createDataFrame(boxes, "page_id long, pred_idx int, x1 int, y1 int, x2 int, y2 int, score double")
    region = spark.createDataFrame([(1, [(0, 0), (199, 0), (199, 119), (0, 119)])], "page_id long, points array<struct<x:int,y:int>>")
    pages = spark.createDataFrame([(1, "a", "a.jpg", 200, 120), (2, "b", "b.jpg", 200, 120)], "page_id long, stem string, file_name string, width int, height int")
    make = lambda: lambda crop: crop[:, :, 0] > 100
    predict.export_boxes(pages, images, table, region, make, str(tmp_path / "xml"), timestamp="2020-01-01T00:00:00")
    read = page_xml.read_pages(spark, str(tmp_path / "xml" / "*"))
    assert {(r.width, r.height) for r in read.collect()} == {(200, 120)} and read.count() == 2
    got = [(r.line_id, [(p.x, p.y) for p in r.points], r.baseline) for r in page_xml.text_lines(read).collect()]
    # numbers have gaps where a box gave no line
    assert sorted(got) == [
        ("textline_0", [(20, 10), (149, 10), (149, 19), (20, 19)], "20,19 149,19"),
        ("textline_1", [(30, 50), (89, 50), (89, 51), (30, 51)], "30,50 30,51 89,50 89,51")]


def test_polygons_to_documents(spark, tmp_path):
    square = lambda x, y: [(x, y), (x + 30, y), (x + 30, y + 9), (x, y + 9)]
    found = spark.createDataFrame([(1, 0, square(5, 50), 0.9), (1, 1, square(5, 10), 0.7), (1, 2, [(1, 1), (2, 2)], 0.9)], "page_id long, det_idx int, points array<struct<x:int,y:int>>, score double")
    pages = spark.createDataFrame([(1, "a", "a.jpg", 200, 120)], "page_id long, stem string, file_name string, width int, height int")
    predict.export_polygons(pages, found, None, str(tmp_path / "xml"))
    lines = page_xml.text_lines(page_xml.read_pages(spark, str(tmp_path / "xml" / "*"))).orderBy("line_idx").collect()
    assert [(r.line_id, r.points[0].y, len(r.points)) for r in lines] == [("textline_0", 10, 4), ("textline_1", 50, 4)]


def test_scores_of_files(spark, tmp_path):
    square = lambda x, y: [(x, y), (x + 30, y), (x + 30, y + 9), (x, y + 9)]
    pages = spark.createDataFrame([(i, s, f"{s}.jpg", 200, 120) for i, s in enumerate(["a", "b", "c", "d + e:f%g"])], "page_id long, stem string, file_name string, width int, height int")

    def write(name, stems, rows):
        df = spark.createDataFrame([(p, i, pts, 0.9) for p, lines in rows.items() for i, pts in enumerate(lines)], "page_id long, det_idx int, points array<struct<x:int,y:int>>, score double")
        predict.export_polygons(pages.filter(F.col("stem").isin(*stems)), df, None, str(tmp_path / name))
        return page_xml.read_pages(spark, str(tmp_path / name / "*"))

    gt = write("gt", ["a", "b", "d + e:f%g"], {0: [square(5, 10), square(5, 40)], 1: [square(5, 10)]})
    pred = write("pred", ["a", "b", "c", "d + e:f%g"], {0: [square(5, 10), square(60, 80)], 2: [square(1, 1)]})
    scores, mean = predict.score_files(gt, pred)
    assert sorted((r.stem, r.N_gt, r.N_pred, r.M, r.DR, r.RA, r.FM) for r in scores.collect()) == [("a", 2, 2, 1, 0.5, 0.5, 0.5), ("b", 1, 0, 0, 0, 0, 0), ("d + e:f%g", 0, 0, 0, 0, 0, 0)]
    total = mean.collect()
    assert len(total) == 1 and total[0].pages == 3 and abs(total[0].mean_DR - 0.5 / 3) < 1e-12
    only = spark.createDataFrame([("a",)], "stem string")
    assert predict.score_files(gt, pred, only)[1].first().mean_FM == 0.5
    assert predict.score_files(gt.limit(0), pred)[1].count() == 0


def test_largest_outline():
    mask = np.zeros((6, 9), bool)
    mask[1:3, 1:4] = mask[4:6, 5:8] = True
    share, points = cuts.largest_outline(mask)
    assert share == 6 / 54 and points == [(1, 1), (3, 1), (3, 2), (1, 2)]
    assert cuts.largest_outline(np.zeros((2, 2), bool)) is None


def test_crop_rows(spark, images):
    lines = spark.createDataFrame([(1, 0, [(2, 3), (6, 3), (6, 5), (2, 5)]), (4, 1, [(0, 0), (8, 0), (8, 39), (0, 39)])], "page_id long, line_idx int, points array<struct<x:int,y:int>>")
    rows = {r.line_idx: r for r in cuts.crop_rows(images, tiles.line_crops(lines, images, pad=2)).collect()}
    assert bytes(rows[0].bytes) == rgb(1)[1:7, 0:8].tobytes() and bytes(rows[1].bytes) == rgb(4).tobytes()
    assert [tuple(m) for m in rows[0]["mask"]] == [(2, 2, 6), (3, 2, 6), (4, 2, 6)]
    assert sum(m.x1 - m.x0 + 1 for m in rows[1]["mask"]) == 360


def test_masks_evaluated_to_files(spark, images, tmp_path):
    named = images.filter("page_id in (1, 2, 4)").withColumn("name", F.concat(F.lit("p"), "page_id", F.lit(".png")))
    truth = {p: RNG.random(SIZES[p][:2]) < 0.4 for p in (1, 4)}
    masks = spark.createDataFrame([(p, *m.shape, 1, (m * 255).astype(np.uint8).tobytes()) for p, m in truth.items()], "page_id long, height int, width int, n_channels int, data binary")
    rated, mean = predict.evaluate_masks(named, masks, make_model, str(tmp_path), size=8, stride=4, threshold=0.3, batch_size=4)
    probs = {(r.page_id, r.y, r.x): r.prob for r in spark.read.parquet(str(tmp_path / "prob_maps")).collect()}
    spans = spark.read.parquet(str(tmp_path / "pred_masks"))
    assert sum(r.x1 - r.x0 + 1 for r in spans.collect()) == sum(v > 0.3 for v in probs.values())
    got = {r.image: r for r in rated.collect()}
    assert got.keys() == {"p1.png", "p4.png"}  # the page without a mask is left out
    for p, m in truth.items():
        pred = np.array([[probs[p, y, x] > 0.3 for x in range(m.shape[1])] for y in range(m.shape[0])])
        tp, fp, fn = (pred & m).sum(), (pred & ~m).sum(), (~pred & m).sum()
        assert abs(got[f"p{p}.png"].IoU - tp / (tp + fp + fn + 1e-6)) < 1e-9 and abs(got[f"p{p}.png"].F1 - 2 * tp / (2 * tp + fp + fn + 1e-6)) < 1e-9
    assert abs(mean.first().Recall - np.mean([r.Recall for r in got.values()])) < 1e-9
    back = spark.read.option("header", True).csv(str(tmp_path / "mask_metrics"))
    assert back.count() == 2 and back.columns == ["image", *predict.METRICS]
    assert spark.read.option("header", True).csv(str(tmp_path / "mask_metrics_summary")).count() == 1


def test_blended_rows_are_made_where_the_image_is(spark, images):
    rows = predict.blended_rows(images.filter("page_id < 5"), make_model, size=8, stride=4, batch_size=3)
    assert {r.page_id: len(r.prob) for r in rows.collect()} == {p: rgb(p).shape[1] for p in IMAGES}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_masks_of_one_width_are_read_together(spark):
    from scriptoria.sources import images as masks

    rng = np.random.default_rng(3)
    heights = [1, 3, 2, 3, 4, 1]
    shapes = [(str(i), h, 4 + i % 2, 1 if i < 4 else 3) for i, h in enumerate(heights)]
    held = {p: (rng.integers(0, 3, (h, w, n)) * 64).astype(np.uint8) for p, h, w, n in shapes}
    rows = [(p, h, w, n, bytearray(held[p].tobytes())) for p, h, w, n in shapes] + [("no", 2, 2, 1, None)]
    images = spark.createDataFrame(rows, "path string, height int, width int, n_channels int, data binary").coalesce(1)
    found = {(r.path, r.y, x) for r in masks.mask_spans(images, "above_127").collect() for x in range(r.x0, r.x1 + 1)}
    gray = {p: v.astype(int) @ [114, 587, 299] if v.shape[2] == 3 else v[..., 0].astype(int) * 1000 for p, v in held.items()}
    assert found == {(p, y, x) for p, g in gray.items() for y, x in np.argwhere((g + 500) // 1000 > 127).tolist()}
    kept = masks.mask_spans(images, "above_127", on_missing="keep").filter("kind is null").collect()
    assert [r.path for r in kept] == ["no"]


def test_rated_rows_of_pixels_with_gaps(spark):
    # pixels in any order, some of them missing
    probs = spark.createDataFrame([(1, 0, 2, 0.9), (1, 0, 0, 0.1), (1, 1, 1, 0.8), (2, 0, 0, 0.9)], "page_id long, y int, x int, prob double")
    masks = spark.createDataFrame([(1, 2, 3, 1, bytearray([255, 0, 255, 0, 0, 0]))], "page_id long, height int, width int, n_channels int, data binary")
    (row,) = predict.rated_masks(probs, masks, 0.5).collect()
    assert row.page_id == 1 and abs(row.IoU - 1 / 3) < 1e-5 and abs(row.Recall - 0.5) < 1e-5


def test_crops_traced_together():
    """Crops of any size traced in one go give what each gives alone; before, there was one pass for each crop."""
    from scriptoria.operators import components as C
    from scriptoria.operators.borders import run_outlines
    from scriptoria.sources.images import runs

    masks = [RNG.random((h, w)) < share for h, w in ((1, 1), (1, 9), (9, 1), (5, 7), (30, 40)) for share in (0.0, 0.2, 0.5, 0.8, 1.0) for _ in range(3)]
    of, ratio, count, px, py = cuts.largest_outlines(masks)
    assert of.tolist() == [i for i, m in enumerate(masks) if m.any()]
    ends = np.append(0, np.cumsum(count))
    for k, i in enumerate(of.tolist()):
        y, x0, x1 = (v.astype(np.int64) for v in runs(masks[i]))
        root = C.label_sorted_spans(np.zeros(len(y), np.int64), y, x0, x1)
        area = np.bincount(root, x1 - x0 + 1)
        own = root == int(area.argmax())
        _, x, z = run_outlines(np.zeros(int(own.sum()), np.int64), y[own], x0[own], x1[own])
        assert ratio[k] == area.max() / masks[i].size
        assert (px[ends[k]:ends[k + 1]].tolist(), py[ends[k]:ends[k + 1]].tolist()) == (x.tolist(), z.tolist())
