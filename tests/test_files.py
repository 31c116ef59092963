"""Round trips through real files written by the test."""

import json
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import selection as sel
from scriptoria.operators import spans as R
from scriptoria.plans.convert import masks_to_coco, pages_to_coco, pages_to_yolo
from scriptoria.plans.prepare import prepare_few_shot
from scriptoria.sources import coco, files, images, notes, page_xml, tables, yolo
from scriptoria.streaming import memory as stream

NS = page_xml.NAMESPACE


def png(path: Path, rows):
    """An RGB PNG of rows of (r, g, b)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def xml(path: Path, style: str, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    pre, decl = {"default": ("", f' xmlns="{NS}"'), "none": ("", ""), "prefixed": ("pc:", f' xmlns:pc="{NS}"')}[style]
    body = "".join(
        f'<{pre}TextLine id="l{i}">' + (f'<{pre}Coords points="{p}"/>' if p else "") + f"</{pre}TextLine>" for i, p in enumerate(lines)
    )
    path.write_text(
        f'<?xml version="1.0"?><{pre}PcGts{decl}><{pre}Page imageFilename="{path.stem}.png" imageWidth="40" imageHeight="30">'
        f'<{pre}TextRegion id="r"><{pre}Coords points="0,0 40,0 40,30 0,30"/>{body}</{pre}TextRegion></{pre}Page></{pre}PcGts>'
    )


@pytest.mark.parametrize("style", ["default", "none", "prefixed"])
def test_page_xml_styles(spark, tmp_path, style):
    xml(tmp_path / "a.xml", style, ["1,2 3,4 5,6", None, "7,8 9,9"])
    pages = page_xml.read_pages(spark, str(tmp_path))
    every = page_xml.text_lines(pages, "all_lines").orderBy("line_idx").collect()
    assert [(r.line_idx, r.line_id, len(r.points)) for r in every] == [(0, "l0", 3), (1, "l2", 2)]
    assert page_xml.text_lines(pages, "polygons").count() == 1
    assert page_xml.text_lines(pages, "decimal").first().points[0].x == 1.0
    assert page_xml.main_region(page_xml.regions(pages)).first().region_idx == 0


@pytest.mark.parametrize("profile", list(page_xml.WRITE_PROFILES))
def test_page_xml_round_trip(spark, tmp_path, profile):
    pages = spark.createDataFrame([("a", "a&b.png", 40, 30), ("b", "b.png", 40, 30)], "stem string, file_name string, width int, height int")
    lines = spark.createDataFrame([("a", i, f"{i},0 9,{i} 4,4", "0,1 2,1") for i in range(12)], "stem string, line_no int, points string, baseline string")
    page_xml.write_documents(page_xml.document_rows(pages, lines, profile), str(tmp_path / "out"))
    assert not list((tmp_path / "out" / "stem=a").glob("part-*"))[1:]
    back = page_xml.read_pages(spark, str(tmp_path / "out" / "*"))
    assert {r.image for r in back.collect()} == {"a&b.png", "b.png"}
    got = page_xml.text_lines(back.withColumn("stem", F.regexp_extract("image", "^(.)", 1))).orderBy("line_idx")
    assert [point_text(r.points) for r in got.collect()] == [f"{i},0 9,{i} 4,4" for i in range(12)]


def point_text(points):
    return " ".join(f"{p.x},{p.y}" for p in points)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """A small colour-coded corpus of one manuscript."""
    root = tmp_path_factory.mktemp("corpus")
    for split, n in (("training", 4), ("validation", 1), ("public-test", 1)):
        for i in range(n):
            stem = f"{split}_{i}"
            page = [[(10 * i, 0, 8 if 5 <= x < 15 + i and 3 <= y < 8 else 1) for x in range(40)] for y in range(30)]
            page[20][30] = (128, 0, 8)
            png(root / f"M1/img-M1/img/{split}/{stem}.png", page)
            png(root / f"M1/pixel-level-gt-M1/pixel-level-gt/{split}/{stem}.png", page)
            xml(root / f"M1/PAGE-gt-M1/PAGE-gt/{split}/{stem}.xml", "default", ["5,3 14,3 14,7 5,7"])
    return root


def test_manifest_and_preparation(spark, corpus):
    listing = files.list_files(spark, str(corpus))
    assert files.list_images(listing).count() == 12
    pages = files.manifest(listing, "diva")
    rows = {r.stem: r for r in pages.collect()}
    assert len(rows) == 6 and rows["training_0"].split == "train" and rows["public-test_0"].xml_path.endswith(".xml")
    ready = prepare_few_shot(spark, listing, "diva", "M1", 1, "random")
    assert (ready.labeled.count(), ready.unlabeled.count(), ready.pairs.count()) == (1, 3, 3)


def test_missing_split_folder_is_an_error(spark, tmp_path):
    png(tmp_path / "M2/img-M2/train/a.png", [[(0, 0, 0)]])
    png(tmp_path / "M2/text-line-gt-M2/train/a.png", [[(0, 0, 0)]])
    with pytest.raises(Exception, match="no folder for"):
        files.manifest(files.list_files(spark, str(tmp_path)), "u_diads").collect()


def test_masks_from_bytes(spark, corpus):
    masks = images.mask_spans(files.read_images(spark, str(corpus / "M1/pixel-level-gt-M1/pixel-level-gt/training")), "colour_coded")
    area = {r.path.rsplit("/", 1)[1]: r.a for r in masks.filter("kind = 'text'").groupBy("path").agg(R.span_area().alias("a")).collect()}
    assert area["training_0.png"] == 51 and area["training_3.png"] == 66
    assert masks.filter("kind = 'dont_care'").count() == 4
    levels = images.gray_variance(files.read_images(spark, str(corpus / "M1/img-M1/img/training")))
    best = sel.top_by_variance(levels.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.png$", 1)), 1).first()
    by_hand = levels.orderBy(F.desc("variance")).first()
    assert by_hand.path.endswith(best.stem + ".png")


def test_image_sizes(spark, corpus):
    row = files.image_sizes(spark, str(corpus / "M1/img-M1/img/validation")).first()
    assert (row.width, row.height) == (40, 30)


def test_conversion_to_coco_and_yolo(spark, corpus, tmp_path):
    docs = page_xml.read_pages(spark, str(corpus / "M1/PAGE-gt-M1/PAGE-gt/*"))
    pages = docs.select("stem", F.concat("stem", F.lit(".png")).alias("file_name"), "width", "height",
                        F.lit("M1").alias("manuscript"), F.regexp_extract("stem", "^([a-z]+)", 1).alias("split"))
    image_rows, annotation_rows = pages_to_coco(pages, docs)
    coco.write_documents(coco.document_rows(image_rows, annotation_rows, ["manuscript", "split"]), str(tmp_path / "coco"), ["manuscript", "split"])
    folder = tmp_path / "coco/manuscript=M1/split=training"
    [only] = folder.glob("part-*")
    text = only.read_text()
    doc = json.loads(text)
    assert [i["id"] for i in doc["images"]] == [1, 2, 3, 4]
    assert [a["image_id"] for a in doc["annotations"]] == [1, 2, 3, 4]
    assert doc["annotations"][0]["bbox"] == [5, 3, 9, 4] and doc["annotations"][0]["area"] == 36

    back = coco.read_documents(spark, str(folder))
    assert coco.images(back).count() == 4
    whole = coco.read_documents(spark, str(tmp_path / "coco/*/*"))
    assert whole.count() == image_rows.select("manuscript", "split").distinct().count()
    assert coco.annotations(whole).count() == annotation_rows.count()
    labels = yolo.labels_from_coco(coco.images(back), coco.annotations(back)).collect()
    assert labels[0].line.startswith("0 0.125000 0.100000 ")

    rows = pages_to_yolo(pages, docs)
    yolo.write_labels(rows, str(tmp_path / "yolo"), ["line_idx"])
    read = yolo.read_labels(spark, str(tmp_path / "yolo/*/*"))
    assert read.count() == 6 and read.filter(yolo.label_kind(F.col("line")) == "box").count() == 6


def test_masks_to_coco(spark, corpus):
    masks = images.mask_spans(files.read_images(spark, str(corpus / "M1/pixel-level-gt-M1/pixel-level-gt/training")), "colour_coded").filter("kind = 'text'")
    ids = {p: i for i, p in enumerate(sorted(r.path for r in masks.select("path").distinct().collect()))}
    keyed = masks.withColumn("page_id", F.regexp_extract("path", r"_(\d)\.png$", 1).cast("long"))
    pages = spark.createDataFrame([(i, "M1", "train", f"training_{i}.png", 40, 30) for i in range(4)], "page_id long, manuscript string, split string, file_name string, width int, height int")
    image_rows, ann = masks_to_coco(pages, keyed.select("page_id", "y", "x0", "x1"), min_area=2)
    got = ann.orderBy("ann_id").collect()
    assert len(ids) == 4 and [r.ann_id for r in got] == [1, 2, 3, 4]
    assert [list(r.bbox) for r in got] == [[5, 3, 10 + i, 5] for i in range(4)]


def test_metric_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DR,RA,image\n0.5,0.25,x\nn/a,0.75,y\n")
    (tmp_path / "b.csv").write_text("image,DR\nz,1.0\n")
    rows = tables.read_metrics(spark, str(tmp_path), ["DR", "RA", "FM"])
    mean = tables.mean_of_columns(rows, ["DR", "RA", "FM"]).first()
    assert (mean.DR, mean.RA) == (0.75, 0.5) and mean.FM != mean.FM
    assert tables.write_metrics(rows.filter("DR > 5"), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()
    assert tables.write_metrics(rows, str(tmp_path / "some")) is True


def test_metric_files_with_line_ends_in_cells_and_in_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,DR\n"two\nlines ""x""",0.5\nplain, 0.25\n\n"",\n')
    (tmp_path / "b.csv").write_text("name,DR\n" + "".join(f"row{i},{i}\n" for i in range(5000)))
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("DR\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        rows = tables.read_metrics(spark, str(tmp_path), ["DR", "RA"]).cache()
        got = sorted((r.path.rsplit("/", 1)[1], r.row_no, r.DR, r.RA) for r in rows.filter("path like '%a.csv' or row_no in (0, 4999)").collect())
        assert rows.count() == 5003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [g for g in got if g[0] == "a.csv"] == [("a.csv", 0, 0.5, None), ("a.csv", 1, 0.25, None), ("a.csv", 2, None, None)]
    assert [g for g in got if g[0] == "b.csv"] == [("b.csv", 0, 0.0, None), ("b.csv", 4999, 4999.0, None)]


def test_no_metric_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert tables.read_metrics(spark, str(tmp_path), ["DR"]).count() == 0


def test_notes_file(spark, tmp_path):
    path = tmp_path / "pick.txt"
    path.write_text("  Grayscale variance method:\n    Image 1: a_max.jpg (variance: 1.0)\n\nPCA centroid method:\n    Image 0: c.jpg\n")
    pages = spark.createDataFrame([("z", 1.0)], "stem string, variance double")
    pick = lambda method, p=str(path): [r.stem for r in sel.select_labeled(spark, pages, 5, method, p).collect()]
    assert pick("grayscale_variance") == ["a_max"] and pick("pca_centroid") == ["c"]
    assert pick("grayscale_variance", str(tmp_path / "absent.txt")) == ["z"]
    with pytest.raises(ValueError, match="no entries"):
        notes.pages_of_file(spark, str(path), "ica_centroid")
    with pytest.raises(ValueError, match="unknown selection method"):
        sel.select_labeled(spark, pages, 1, "pca_centroid")


def test_rebuild_policies(spark, tmp_path):
    out = str(tmp_path / "t")
    df = lambda v: spark.createDataFrame([("a", v), ("b", v)], "k string, v int")
    tables.write_with_policy(df(1), out, "rebuild", ["k"])
    tables.write_with_policy(df(2), out, "reuse", ["k"])
    assert {r.v for r in spark.read.parquet(out).collect()} == {1}
    tables.write_with_policy(df(3).filter("k = 'a'"), out, "refresh", ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {("a", 3), ("b", 1)}


def test_copy_only_new_images(spark, corpus, tmp_path):
    listing = files.list_files(spark, str(corpus / "M1/img-M1/img/training")).withColumn("split", F.lit("train"))
    out = str(tmp_path / "images")
    root = str(corpus / "M1/img-M1/img/training")
    files.copy_new_images(spark, listing, out, root)
    held = spark.read.parquet(out)
    assert held.count() == 4
    files.copy_new_images(spark, listing, out, root, held.select("split", "name"))
    assert spark.read.parquet(out).count() == 4


def test_box_table_and_descriptor(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "a.png"), (2, "b", "b.png")], "page_id long, stem string, file_name string")
    lines = spark.createDataFrame([(1, 0, 1, 2, 3, 4, 12.0)], "page_id long, line_idx int, x int, y int, w int, h int, area double")
    tables.write_boxes(tables.box_rows(pages, lines, ["page_id"]), str(tmp_path / "boxes"))
    assert [p.name for p in sorted((tmp_path / "boxes").glob("stem=*"))] == ["stem=a"]
    assert tables.dataset_descriptor(spark, "/data").count() == 3


def test_stream_memory_in_batches(spark, tmp_path):
    source, progress = tmp_path / "in", str(tmp_path / "progress")
    for b, ids in enumerate(([0, 1, 2], [3, 4], [5, 6, 7, 8, 9, 10])):
        df = spark.createDataFrame([(0, i, [float(i)]) for i in ids] + [(1, 100 + b, [0.0])], stream.SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(source))
    assert stream.read_memory(spark, progress).count() == 0
    run = lambda: stream.keep_last_per_class(
        stream.stream_vectors(spark, str(source), files_per_batch=1), 4, progress
    ).awaitTermination()
    run()
    held = stream.read_memory(spark, progress)
    assert sorted(r.arrival for r in held.filter("label = 0").collect()) == [7, 8, 9, 10]
    assert sorted(r.arrival for r in held.filter("label = 1").collect()) == [100, 101, 102]
    assert all(r.embedding == [float(r.arrival)] for r in held.filter("label = 0").collect())
    assert stream.read_memory(spark, progress, batch=1).count() == 6
    run()  # nothing new: the state stays
    assert stream.read_memory(spark, progress).count() == 7


def test_stream_memory_of_odd_rows(spark, tmp_path):
    """No class is a class, no vector is kept as it is, no arrival is not kept; equal arrivals fall by vector."""
    rows = [(None, 5, [1.0]), (2, None, [1.0]), (3, 1, None), (4, 9, [1.0]), (4, 9, [3.0]), (4, 9, [2.0]), (4, 9, [3.0]), (4, 2**60 + 1, [])]
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    spark.createDataFrame(rows, stream.SCHEMA).repartition(3).write.parquet(source)
    stream.keep_last_per_class(stream.stream_vectors(spark, source), 3, progress).awaitTermination()
    held = {(r.label, r.arrival, tuple(r.embedding) if r.embedding is not None else None): 1 for r in stream.read_memory(spark, progress).collect()}
    assert set(held) == {(None, 5, (1.0,)), (3, 1, None), (4, 2**60 + 1, ()), (4, 9, (3.0,))}
    assert stream.read_memory(spark, progress).where("label = 4").count() == 3


def test_stream_memory_of_an_empty_table(spark, tmp_path):
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    spark.createDataFrame([], stream.SCHEMA).write.parquet(source)
    stream.keep_last_per_class(stream.stream_vectors(spark, source), 3, progress).awaitTermination()
    assert stream.read_memory(spark, progress).count() == 0


def test_span_and_probability_tables(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 0.999), (1, 0, 1, 1.2)], "page_id long, y int, x int, prob double")
    tables.write_probabilities(px, str(tmp_path / "p"))
    assert sorted(r.level for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [254, 255]
    tables.write_masks(R.pixels_to_spans(px, ["page_id"]), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
