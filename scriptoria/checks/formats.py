"""Annotation formats (S-04, S-05, S-07 to S-10, K-01, K-03 to K-06, W-01, W-02, F-03, F-07, A-06 to A-08, X-02)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.checks.registry import check
from scriptoria.functions import geometry as G
from scriptoria.functions import scalars as S
from scriptoria.operators.scan import row_numbers
from scriptoria.samples import Samples, oracle
from scriptoria.session import ensure_checkpoint_dir
from scriptoria.sources import coco, notes, page_xml, tables, yolo

VERTEX = """
vertex as (
  select page_id, line_idx, n, i, cast(split_part(p, ',', 1) as int) as x, cast(split_part(p, ',', 2) as int) as y from (
    select page_id, line_idx, len(string_split(points, ' ')) as n, unnest(string_split(points, ' ')) as p,
      unnest(range(len(string_split(points, ' ')))) as i from poly) v),
edge as (
  select a.page_id as page_id, a.line_idx as line_idx, a.i as i, a.x as x, a.y as y, b.x as nx, b.y as ny
  from vertex a join vertex b on a.page_id = b.page_id and a.line_idx = b.line_idx and b.i = (a.i + 1) % a.n)
"""

SPLIT = "case when split_dir in ('train', 'training') then 'train' when split_dir in ('val', 'validation') then 'val' else 'test' end"

# Pages with an annotation file, numbered in name order; annotations in (page, document) order.
NUMBERED = f"""
annotated as (
  select page_id, stem, manuscript, {SPLIT} as split, concat(stem, ext) as file_name, width, height,
    cast(row_number() over (partition by manuscript, {SPLIT} order by concat(stem, ext)) as int) as image_id
  from page where priority <> '5-LOW'),
ann as (
  select a.*, l.line_idx as line_idx, l.x1 as x1, l.y1 as y1, l.x2 as x2, l.y2 as y2,
    row_number() over (partition by manuscript, split order by image_id, line_idx) as ann_id
  from annotated a join line l using (page_id))
"""


def points(s: Samples):
    return s.poly.withColumn("points", G.parse_points(F.col("points")))


def numbered_pages(s: Samples):
    counts = s.line.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))
    pages = s.page.filter("priority <> '5-LOW'").select(
        "page_id", "stem", "manuscript", S.canonical_split(F.col("split_dir")).alias("split"),
        F.concat("stem", "ext").alias("file_name"), "width", "height",
    )
    pages = pages.join(counts, "page_id", "left").fillna(0, ["n_lines"])
    return coco.number_images(pages, ["manuscript", "split"], [F.col("file_name")])


def annotations(s: Samples):
    return coco.annotate(points(s), numbered_pages(s), ["page_id"])


@check(
    "s04_parse_page_xml",
    oracle("poly", "select page_id, line_idx, cast(count(*) as int) as n, cast(sum(x) as bigint) as sum_x, cast(sum(y * (i + 1)) as bigint) as sum_y from vertex group by page_id, line_idx having count(*) >= 3", VERTEX),
)
def parse_page_xml(s: Samples):
    fragment = page_xml.line_element(F.col("line_idx"), F.col("points"), F.lit("0,0 1,0"), "crops")
    points = page_xml.line_points(page_xml.line_from_fragment(fragment)["Coords"]["_points"], "polygons")
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    weighted = lambda p: F.transform(p, lambda q, i: q["y"].cast("long") * (i + 1))
    sums = lambda p: F.struct(F.size(p).alias("n"), total(G.xs(p)).alias("sum_x"), total(weighted(p)).alias("sum_y"))
    found = G.bound(points, lambda p: F.when(p.isNotNull(), sums(p)))
    return s.poly.select("page_id", "line_idx", G.kept_fields(found, lambda r: r.isNotNull()))


REGION_AREA = """
sized as (select page_id, region_idx, x1, y1, x2, y2, abs(x2 - x1) * abs(y2 - y1) as area from region),
main as (select page_id, arg_min(region_idx, {'a': -area, 'i': region_idx}) as largest, min(region_idx) as first_region from sized group by page_id)
"""


def region_polygons(s: Samples):
    box = G.box_polygon(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return s.region.select("page_id", "region_idx", box.alias("points"))


@check("s05_main_region", oracle("region", "select page_id, largest, first_region from main", REGION_AREA))
def main_region(s: Samples):
    rows = region_polygons(s)
    area = G.contour_area(F.col("points"))
    # Both rules in one pass over the regions.
    return rows.groupBy("page_id").agg(
        F.min(F.struct((-area).alias("cost"), "region_idx")).getField("region_idx").alias("largest"),
        F.min("region_idx").alias("first_region"),
    )


@check(
    "s07_read_coco",
    oracle("line page", """select manuscript, split, ann_id as id, image_id, cast(x1 as double) as x, cast((x2 - x1) as double) as w,
      10 as n_coords, cast((x2 - x1) * (y2 - y1) as double) as area from ann""", NUMBERED),
)
def read_coco(s: Samples):
    text = coco.annotation_json(F.col("ann_id"), F.col("image_id"), F.col("bbox"), F.col("segmentation"), F.col("area"))
    document = F.concat(F.lit('{"images":[],"annotations":['), text, F.lit("]}"))
    documents = annotations(s).select(F.concat_ws("/", "manuscript", "split").alias("path"), F.from_json(document, coco.SCHEMA).alias("d"))
    found = coco.annotations(documents.select("path", "d.*"))
    return found.select(
        F.split("path", "/")[0].alias("manuscript"), F.split("path", "/")[1].alias("split"), F.col("id").cast("long").alias("id"), "image_id",
        F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"), F.size(F.col("segmentation")[0]).alias("n_coords"), "area",
    )


@check(
    "w01_annotation_ids",
    oracle("line page", "select page_id, line_idx, manuscript, split, image_id, ann_id from ann", NUMBERED),
)
def annotation_ids(s: Samples):
    return annotations(s).select("page_id", "line_idx", "manuscript", "split", "image_id", "ann_id")


@check(
    "k01_coco_documents",
    oracle("line page poly", """
      select manuscript, split, part, seq, text from (
        select manuscript, split, 0 as part, cast(0 as bigint) as seq, '{"images":[' as text from annotated group by manuscript, split
        union all
        select manuscript, split, 2, 0, '],"annotations":[' from annotated group by manuscript, split
        union all
        select manuscript, split, 4, 0, '],"categories":[{"id":1,"name":"TextLine","supercategory":"text"}]}' from annotated group by manuscript, split
        union all
        select manuscript, split, 1, image_id, concat(case when image_id = 1 then '' else ',' end, '{"id":', image_id, ',"file_name":"', file_name,
          '","width":', width, ',"height":', height, '}') from annotated
        union all
        select manuscript, split, 3, ann_id, concat(case when ann_id = 1 then '' else ',' end, '{"id":', ann_id, ',"image_id":', image_id,
          ',"category_id":1,"bbox":[', x1, ',', y1, ',', x2 - x1, ',', y2 - y1, '],"segmentation":[[',
          replace(p.points, ' ', ','), ']],"area":', (x2 - x1) * (y2 - y1), ',"iscrowd":0}')
        from ann join poly p using (page_id, line_idx)) u""", NUMBERED),
)
def coco_documents(s: Samples):
    return coco.document_rows(numbered_pages(s), annotations(s), ["manuscript", "split"])


@check(
    "f07_json_roundtrip",
    oracle("line page", "select manuscript, split, ann_id as id, (x2 - x1) * (y2 - y1) as area from ann", NUMBERED),
)
def json_roundtrip(s: Samples):
    text = F.to_json(F.struct(F.col("ann_id").alias("id"), F.struct("area").alias("shape")))
    back = F.from_json(text, "id long, shape struct<area:int>")
    return annotations(s).select("manuscript", "split", back.alias("b")).select("manuscript", "split", "b.id", "b.shape.area")


FIXED_LABEL = """select page_id, line_idx, concat_ws(' ', '0', format('{:.6f}', (x1 + x2) / 2 / width), format('{:.6f}', (y1 + y2) / 2 / height),
  format('{:.6f}', (x2 - x1) / width), format('{:.6f}', (y2 - y1) / height)) as line from line join page using (page_id)"""


@check("k03_yolo_box_labels", oracle("line page", FIXED_LABEL))
def yolo_box_labels(s: Samples):
    rows = s.line.join(s.page.select("page_id", "width", "height"), "page_id")
    label = yolo.box_label(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
    return rows.select("page_id", "line_idx", label.alias("line"))


@check(
    "k04_yolo_polygon_labels",
    oracle("poly page", """select v.page_id as page_id, v.line_idx as line_idx,
      concat('0 ', string_agg(concat(format('{:.6f}', v.x / width), ' ', format('{:.6f}', v.y / height)), ' ' order by i)) as line
      from vertex v join page p on p.page_id = v.page_id group by v.page_id, v.line_idx""", VERTEX),
)
def yolo_polygon_labels(s: Samples):
    flat = points(s).select("page_id", "line_idx", G.flatten_points(F.col("points")).alias("flat"))
    rows = flat.join(s.page.select("page_id", "width", "height"), "page_id")
    label = yolo.polygon_label(F.lit(1), F.col("flat"), F.col("width"), F.col("height"))
    return rows.select("page_id", "line_idx", label.alias("line"))


@check(
    "k05_page_xml_documents",
    oracle("poly line page", f"""
      select stem, 0 as part, 0 as seq, concat('<PcGts xmlns="{page_xml.NAMESPACE}" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="{page_xml.NAMESPACE} {page_xml.NAMESPACE}/pagecontent.xsd"><Metadata><Creator>scriptoria</Creator><Created>1970-01-01T00:00:00</Created><LastChange>1970-01-01T00:00:00</LastChange></Metadata><Page imageFilename="', stem, ext, '" imageWidth="', width, '" imageHeight="', height, '"><TextRegion id="r_text"><Coords points="0,0 ', width, ',0 ', width, ',', height, ' 0,', height, '"/>') as text from page
      union all
      select stem, 2, 0, '</TextRegion></Page></PcGts>' from page
      union all
      select g.stem, 1, p.line_idx, concat('<TextLine id="tl_', printf('%04d', p.line_idx), '"><Coords points="', p.points, '"/><Baseline points="',
        l.x1, ',', l.y2, ' ', l.x2 + 1, ',', l.y2, '"/></TextLine>')
      from poly p join line l using (page_id, line_idx) join page g using (page_id)"""),
)
def page_xml_documents(s: Samples):
    pages = s.page.select("page_id", "stem", F.concat("stem", "ext").alias("file_name"), "width", "height")
    # The boxes are those of the polygons, so one pass over the polygons suffices.
    box = G.bounding_box(F.col("parsed"))
    rows = s.poly.withColumn("parsed", G.parse_points(F.col("points"))).withColumn("b", box)
    base = G.baseline_from_box(
        F.col("b.x1"), F.col("b.y1"), F.col("b.x2") - F.col("b.x1") + 1, F.col("b.y2") - F.col("b.y1") + 1, "bottom"
    )
    lines = rows.join(pages.select("page_id", "stem"), "page_id").select(
        "stem", F.col("line_idx").alias("line_no"), "points", G.format_points(base).alias("baseline")
    )
    return page_xml.document_rows(pages, lines, "components")


@check(
    "k06_box_csv",
    oracle("line page", """select stem, concat(stem, ext) as image_filename, concat('textline_', line_idx) as textline_id, x1 as x, y1 as y,
      x2 - x1 + 1 as width, y2 - y1 + 1 as height, cast((x2 - x1) * (y2 - y1) as double) as area from line join page using (page_id)"""),
)
def box_csv(s: Samples):
    lines = s.line.select(
        "page_id", "line_idx", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1") + 1).alias("w"),
        (F.col("y2") - F.col("y1") + 1).alias("h"),
        G.contour_area(G.box_polygon(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("area"),
    )
    return tables.box_rows(s.page.withColumn("file_name", F.concat("stem", "ext")), lines, ["page_id"]).drop("line_idx")


@check(
    "w02_line_ids",
    oracle("line", """select page_id, line_idx, concat('tl_', printf('%04d', row_number() over (partition by page_id order by line_idx) - 1)) as dense_id,
      concat('textline_', line_idx) as gapped_id from line where (x2 - x1) * (y2 - y1) >= 20000"""),
)
def line_ids(s: Samples):
    kept = s.line.filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= 20000)
    ids = row_numbers(kept, ["page_id"], [F.col("line_idx")], "place", start=0)
    return ids.select(
        "page_id", "line_idx", F.format_string("tl_%04d", "place").alias("dense_id"), F.format_string("textline_%d", "line_idx").alias("gapped_id")
    )


@check(
    "f03_fixed_format",
    oracle("line", "select page_id, line_idx, format('{:.6f}', (x1 + x2) / 2 / 1600) as cx, printf('%04d', line_idx) as padded from line"),
)
def fixed_format(s: Samples):
    centre = (F.col("x1") + F.col("x2")) / 2 / 1600
    return s.line.select("page_id", "line_idx", S.fixed(centre).alias("cx"), F.format_string("%04d", "line_idx").alias("padded"))


TOKENS = "tok as (select *, len(regexp_split_to_array(trim(line), '\\s+')) as n, regexp_split_to_array(trim(line), '\\s+') as t from label)"


@check(
    "s08_read_yolo",
    oracle("label page", """select page_id, line_idx, case when n > 5 then 'polygon' when n = 5 then 'box' else 'other' end as kind,
      case when n > 5 then round(list_sum(list_transform(range(1, n, 2), lambda i: cast(t[i + 1] as double) * width)), 6) end as sum_x,
      case when n = 5 then round((cast(t[2] as double) - cast(t[4] as double) / 2) * width, 6) end as x1,
      case when n = 5 then round((cast(t[3] as double) + cast(t[5] as double) / 2) * height, 6) end as y2
      from tok join page using (page_id)""", TOKENS),
)
def read_yolo(s: Samples):
    rows = s.label.join(s.page.select("page_id", "width", "height"), "page_id")
    w, h = F.col("width"), F.col("height")
    polygon, box = yolo.polygon_pixels(F.col("line"), w, h), yolo.box_pixels(F.col("line"), w, h)
    return rows.select(
        "page_id", "line_idx", yolo.label_kind(F.col("line")).alias("kind"),
        F.round(F.aggregate(G.xs(polygon), F.lit(0.0), lambda a, v: a + v), 6).alias("sum_x"),
        F.round(box["x1"], 6).alias("x1"), F.round(box["y2"], 6).alias("y2"),
    )


@check(
    "a08_label_summary",
    oracle("label page", f"""select split, count(*) as images, count(c) as labels, cast(coalesce(sum(polygons), 0) as bigint) as polygon_rows,
      cast(coalesce(sum(boxes), 0) as bigint) as bbox_rows from (select page_id, {SPLIT} as split from page) p
      left join (select page_id, count(*) as c, count(*) filter (where n > 5) as polygons, count(*) filter (where n = 5) as boxes
        from tok group by page_id) l using (page_id) group by split""", TOKENS),
)
def label_summary(s: Samples):
    kind = yolo.label_kind(F.col("line"))
    per_page = s.label.groupBy("page_id").agg(
        F.count_if(kind == "polygon").alias("polygons"), F.count_if(kind == "box").alias("boxes")
    )
    pages = s.page.select("page_id", S.canonical_split(F.col("split_dir")).alias("split")).join(per_page, "page_id", "left")
    return pages.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.count("polygons").alias("labels"),
        F.coalesce(F.sum("polygons"), F.lit(0)).alias("polygon_rows"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("bbox_rows"),
    )


@check(
    "s09_read_metrics",
    oracle("metric", "select user_id, count(try_cast(dr_text as double)) as n_read, count(*) as n_rows, round(avg(try_cast(dr_text as double)), 6) as mean_dr from metric group by user_id"),
)
def read_metrics(s: Samples):
    # written as CSV files first, with the columns in another order in some of them
    folder = f"{ensure_checkpoint_dir(s.spark)}/metrics-{uuid.uuid4().hex}"
    for i, columns in enumerate((["user_id", "dr_text"], ["dr_text", "user_id"])):
        s.metric.filter(F.col("user_id") % 2 == i).select(*columns).write.option("header", True).csv(f"{folder}/{i}")
    rows = tables.read_metrics(s.spark, [f"{folder}/{i}" for i in (0, 1)], ["user_id", "dr_text"])
    return rows.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(
        F.count("dr_text").alias("n_read"), F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("dr_text"), 6).alias("mean_dr")
    )


@check("a06_mean_csv", oracle("metric", "select round(avg(try_cast(dr_text as double)), 6) as dr_text from metric"))
def mean_csv(s: Samples):
    return tables.mean_of_columns(s.metric, ["dr_text"]).withColumn("dr_text", F.round("dr_text", 6))


@check(
    "a07_mean_iu",
    oracle("metric epoch", """select round(avg("LinesIU"), 6) as mean_lines_iu, round(avg("PixelIU"), 6) as mean_pixel_iu from (
      select try_cast(dr_text as double) as "LinesIU", cast(null as double) as "PixelIU" from metric
      union all select val_iou, loss from epoch) u"""),
)
def mean_iu(s: Samples):
    first = s.metric.select(F.col("dr_text").try_cast("double").alias("LinesIU"))
    second = s.epoch.select(F.col("loss").alias("PixelIU"), F.col("val_iou").alias("LinesIU"))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.agg(F.round(F.avg("LinesIU"), 6).alias("mean_lines_iu"), F.round(F.avg("PixelIU"), 6).alias("mean_pixel_iu"))


NOTES = """
event as (
  select *, rtrim(line) as t, case when contains(line, 'Grayscale variance method') then 1
    when rtrim(line) <> '' and not starts_with(line, ' ') then 0 end as event from note),
state as (
  select *, last_value(event ignore nulls) over (partition by file_id order by n rows between unbounded preceding and current row) as inside from event),
hit as (
  select file_id, n, regexp_extract(t, 'Image\\s+\\d+:\\s+(\\S+\\.jpg)', 1) as name from state where event is null and inside = 1)
"""


@check(
    "s10_selection_notes",
    oracle("note", """select file_id, rank, stem from (
      select file_id, cast(row_number() over (partition by file_id order by n) as int) as rank, regexp_replace(name, '\\.[^.]*$', '') as stem
      from hit where name <> '') r where rank <= 3""", NOTES),
)
def selection_notes(s: Samples):
    return notes.listed_pages(s.note, "grayscale_variance", 3)


@check("w07_open_section", oracle("note", "select file_id, n, inside from state", NOTES))
def open_section(s: Samples):
    from scriptoria.operators.scan import prefix_scan

    line = F.regexp_replace("line", r"\s+$", "")
    opens = line.contains(notes.HEADINGS["grayscale_variance"])
    event = F.when(opens, 1).when((line != "") & ~line.startswith(" "), 0)
    return prefix_scan(s.note.select("file_id", "n", event.alias("event")), ["file_id"], [F.col("n")], {"inside": ("last", F.col("event"))}).drop("event")


@check("x02_explode_vertices", oracle("poly", "select page_id, line_idx, cast(i as int) as i, x, y from vertex", VERTEX))
def explode_vertices(s: Samples):
    return points(s).select("page_id", "line_idx", F.posexplode("points").alias("i", "p")).select("page_id", "line_idx", "i", "p.x", "p.y")
