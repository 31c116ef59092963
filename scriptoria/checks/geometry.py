"""Geometry columns (G-01 to G-17, P()-04, P()-05, W-03, J-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks.formats import VERTEX, points, region_polygons
from scriptoria.checks.registry import check
from scriptoria.functions import geometry as G
from scriptoria.functions import scalars as S
from scriptoria.operators import lines as L
from scriptoria.operators.scan import spread
from scriptoria.samples import Samples, oracle
from scriptoria.sources import page_xml, yolo

KEYS = ("page_id", "line_idx")


def P():
    return F.col("points")


def long_sum(values):
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def double_sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@check(
    "g01_points",
    oracle("poly", "select page_id, line_idx, cast(max(n) as int) as n, cast(sum(x) as bigint) as sum_x, cast(sum(y) as bigint) as sum_y, string_agg(concat(x, ',', y), ' ' order by i) as text from vertex group by page_id, line_idx", VERTEX),
)
def parse_and_format(s: Samples):
    return points(s).select(
        *KEYS, F.size(P()).alias("n"), long_sum(G.xs(P())).alias("sum_x"), long_sum(G.ys(P())).alias("sum_y"), G.format_points(P()).alias("text")
    )


@check(
    "g02_box",
    oracle("poly", "select page_id, line_idx, min(x) as x1, min(y) as y1, max(x) as x2, max(y) as y2 from vertex group by page_id, line_idx", VERTEX),
)
def box(s: Samples):
    return points(s).select(*KEYS, G.bounding_box(P()).alias("box")).select(*KEYS, "box.*")


@check(
    "g03_box_xywh",
    oracle("poly", "select page_id, line_idx, min(x) as x, min(y) as y, max(x) - min(x) as w, max(y) - min(y) as h from vertex group by page_id, line_idx", VERTEX),
)
def box_xywh(s: Samples):
    b = points(s).select(*KEYS, G.bounding_xywh(P()).alias("b"))
    return b.select(*KEYS, *[F.col("b")[i].alias(n) for i, n in enumerate("xywh")])


@check(
    "g04_normalised_box",
    oracle("line page", """select page_id, line_idx, round((x1 + x2) / 2 / width, 9) as cx, round((y1 + y2) / 2 / height, 9) as cy,
      round((x2 - x1) / width, 9) as w, round((y2 - y1) / height, 9) as h from line join page using (page_id)"""),
)
def normalised_box(s: Samples):
    rows = s.line.join(s.page.select("page_id", "width", "height"), "page_id")
    cols = G.normalised_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")])
    return rows.select(*KEYS, *cols).select(*KEYS, *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


@check(
    "g05_denormalised",
    oracle("label page", """select page_id, line_idx,
      round(list_sum(list_transform(range(2, len(t), 2), lambda i: cast(t[i] as double) * width)), 6) as sum_x,
      round(list_sum(list_transform(range(3, len(t) + 1, 2), lambda i: cast(t[i] as double) * height)), 6) as sum_y
      from tok join page using (page_id) where len(t) > 5""", "tok as (select *, string_split(line, ' ') as t from label)"),
)
def denormalised(s: Samples):
    rows = s.label.join(s.page.select("page_id", "width", "height"), "page_id")
    sums = lambda p: F.when(p.isNotNull(), F.struct(*[F.round(double_sum(v(p)), 6).alias(n) for n, v in (("sum_x", G.xs), ("sum_y", G.ys))]))
    found = G.bound(yolo.polygon_pixels(F.col("line"), F.col("width"), F.col("height")), sums)
    return rows.select(*KEYS, G.kept_fields(found, lambda r: r.isNotNull()))


@check(
    "g06_flatten",
    oracle("poly", "select page_id, line_idx, replace(points, ' ', ',') as flat from poly"),
)
def flatten(s: Samples):
    return points(s).select(*KEYS, F.array_join(F.transform(G.flatten_points(P()), lambda v: v.cast("string")), ",").alias("flat"))


@check(
    "g07_areas",
    oracle("poly", """select page_id, line_idx, abs(sum(x * ny - nx * y)) / 2.0 as contour,
      cast((max(x) - min(x)) * (max(y) - min(y)) as bigint) as box from edge group by page_id, line_idx""", VERTEX),
)
def areas(s: Samples):
    b = G.bounding_xywh(P())
    return points(s).select(*KEYS, G.contour_area(P()).alias("contour"), (b[2] * b[3]).cast("long").alias("box"))


@check(
    "g08_perimeter",
    oracle("poly", "select page_id, line_idx, round(sum(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny))), 6) as perimeter from edge group by page_id, line_idx", VERTEX),
)
def perimeter(s: Samples):
    return points(s).select(*KEYS, F.round(G.perimeter(P()), 6).alias("perimeter"))


@check("g09_simplify")
def simplify(s: Samples):
    out = spread(points(s)).select(*KEYS, F.size(P()).alias("n_before"), G.simplify(P(), 0.0025).alias("p"))
    return out.select(*KEYS, "n_before", F.size("p").alias("n_after"), G.format_points(F.col("p")).alias("text"))


@check(
    "g10_centroid",
    oracle("poly", "select page_id, line_idx, round(avg(x), 6) as cx, round(avg(y), 6) as cy from vertex group by page_id, line_idx", VERTEX),
)
def centroid(s: Samples):
    return points(s).select(*KEYS, F.round(G.mean_x(P()), 6).alias("cx"), F.round(G.mean_y(P()), 6).alias("cy"))


@check(
    "g11_point_in_polygon",
    oracle("poly pred region", """select r.page_id as page_id, r.region_idx as region_idx, p.pred_idx as pred_idx,
      floor((p.x1 + p.x2) / 2) between least(r.x1, r.x2) and greatest(r.x1, r.x2)
      and floor((p.y1 + p.y2) / 2) between least(r.y1, r.y2) and greatest(r.y1, r.y2) as inside
      from region r join pred p on p.page_id = r.page_id"""),
)
def point_in_polygon(s: Samples):
    # Two regions per page: they travel as one array per page, so each box is read once.
    regions = region_polygons(s).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_idx", "points"))).alias("regions"))
    rows = s.pred.join(regions, "page_id").select(
        "page_id", "pred_idx", F.floor((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.floor((F.col("y1") + F.col("y2")) / 2).alias("cy"),
        F.explode("regions").alias("r"),
    )
    return rows.select("page_id", "r.region_idx", "pred_idx", G.contains_point(F.col("r.points"), F.col("cx"), F.col("cy")).alias("inside"))


@check(
    "g12_baseline_band",
    oracle("poly", """select page_id, line_idx, string_agg(concat(x, ',', y), ' ' order by x, y) as baseline from (
      select *, max(y) over (partition by page_id, line_idx) as low from vertex) v where y >= low - 2 group by page_id, line_idx""", VERTEX),
)
def baseline_band(s: Samples):
    return points(s).select(*KEYS, G.format_points(G.baseline_bottom_band(P())).alias("baseline"))


@check(
    "g13_baseline_percentile",
    oracle("poly", """select page_id, line_idx, concat(min(x), ',', b, ' ', max(x), ',', b) as baseline from (
      select *, cast(round_even(quantile_cont(y, 0.9) over (partition by page_id, line_idx), 0) as int) as b from vertex) v
      group by page_id, line_idx, b""", VERTEX),
)
def baseline_percentile(s: Samples):
    return points(s).select(*KEYS, G.format_points(G.baseline_percentile(P())).alias("baseline"))


@check(
    "g14_baseline_box",
    oracle("line", """select page_id, line_idx, concat(x1, ',', y2, ' ', x2 + 1, ',', y2) as bottom,
      concat(x1, ',', y1 + (y2 - y1 + 1) // 2, ' ', x2 + 1, ',', y1 + (y2 - y1 + 1) // 2) as middle from line"""),
)
def baseline_box(s: Samples):
    x, y = F.col("x1"), F.col("y1")
    w, h = F.col("x2") - x + 1, F.col("y2") - y + 1
    return s.line.select(
        *KEYS, G.format_points(G.baseline_from_box(x, y, w, h, "bottom")).alias("bottom"),
        G.format_points(G.baseline_from_box(x, y, w, h, "middle")).alias("middle"),
    )


@check(
    "g15_padded_crop",
    oracle("line poly page", """select l.page_id as page_id, l.line_idx as line_idx, greatest(0, l.x1 - 15) as x1, greatest(0, l.y1 - 15) as y1,
      least(width, l.x2 + 15) as x2, least(height, l.y2 + 15) as y2,
      (select string_agg(concat(v.x - greatest(0, l.x1 - 15), ',', v.y - greatest(0, l.y1 - 15)), ' ' order by v.i) from vertex v
        where v.page_id = l.page_id and v.line_idx = l.line_idx) as shifted
      from line l join page g on g.page_id = l.page_id""", VERTEX),
)
def padded_crop(s: Samples):
    rows = points(s).join(s.page.select("page_id", "width", "height"), "page_id").withColumn("b", G.bounding_box(P()))
    rows = rows.withColumn("c", G.padded_box(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), F.col("width"), F.col("height")))
    return rows.select(*KEYS, "c.*", G.format_points(G.shift(P(), -F.col("c.x1"), -F.col("c.y1"))).alias("shifted"))


@check(
    "g16_flip_rotate",
    oracle("poly page", """select v.page_id as page_id, v.line_idx as line_idx, cast(sum(width - 1 - x) as bigint) as flipped_x,
      round(sum(cos(radians(3.0)) * (x - width / 2) + sin(radians(3.0)) * (y - height / 2) + width / 2), 5) as rotated_x,
      round(sum(-sin(radians(3.0)) * (x - width / 2) + cos(radians(3.0)) * (y - height / 2) + height / 2), 5) as rotated_y,
      cast(sum(least(greatest(x - 100, 0), 447)) as bigint) as cropped_x
      from vertex v join page p on p.page_id = v.page_id group by v.page_id, v.line_idx""", VERTEX),
)
def flip_rotate(s: Samples):
    rows = points(s).join(s.page.select("page_id", "width", "height"), "page_id")
    turned = G.rotate(P(), F.lit(3.0), F.col("width") / 2, F.col("height") / 2)
    return rows.withColumn("turned", turned).select(
        *KEYS, long_sum(G.xs(G.flip_horizontal(P(), F.col("width")))).alias("flipped_x"),
        F.round(double_sum(G.xs(F.col("turned"))), 5).alias("rotated_x"), F.round(double_sum(G.ys(F.col("turned"))), 5).alias("rotated_y"),
        long_sum(G.xs(G.clip_to_crop(P(), F.lit(100), F.lit(0), F.lit(448)))).alias("cropped_x"),
    )


@check(
    "g17_polygon_iou",
    oracle("line", """select page_id, line_idx, round(case when dx < w and dy < h
        then cast((w - dx) * (h - dy) as double) / (2 * w * h - (w - dx) * (h - dy)) else 0.0 end, 6) as iou
      from (select page_id, line_idx, x2 - x1 as w, y2 - y1 as h, cast(pk % 13 * 6 as int) as dx, cast(sk % 7 as int) as dy from line) b"""),
)
def polygon_iou(s: Samples):
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    a = G.box_polygon(*corners)
    moved = G.shift(a, (F.col("pk") % 13 * 6).cast("int"), (F.col("sk") % 7).cast("int"))
    return spread(s.line).select(*KEYS, F.round(G.polygon_iou(a, moved), 6).alias("iou"))


@check("p04_min_area", oracle("line", "select page_id, line_idx from line where (x2 - x1 + 1) * (y2 - y1 + 1) >= 20000"))
def min_area(s: Samples):
    return s.line.filter((F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1) >= 20000).select(*KEYS)


@check(
    "p05_enough_points",
    oracle("poly", """select page_id, line_idx, cast(count(*) as int) as n, cast(count(*) filter (where y >= low - 2) as int) as n_base from (
      select *, max(y) over (partition by page_id, line_idx) as low from vertex) v
      group by page_id, line_idx having count(*) >= 3 and count(*) filter (where y >= low - 2) >= 2""", VERTEX),
)
def enough_points(s: Samples):
    sizes = lambda p: F.struct(F.size(p).alias("n"), F.size(G.baseline_bottom_band(p)).alias("n_base"))
    found = G.bound(G.parse_points(P()), sizes)
    return s.poly.select(*KEYS, G.kept_fields(found, lambda r: (r["n"] >= 3) & (r["n_base"] >= 2)))


@check(
    "w03_reading_order",
    oracle("poly", """select page_id, line_idx, cast(row_number() over (partition by page_id order by avg(y), line_idx) as int) as place
      from vertex group by page_id, line_idx""", VERTEX),
)
def reading_order(s: Samples):
    return L.reading_order(points(s)).select(*KEYS, "place")


@check(
    "j09_region_filter",
    oracle("pred region", """select page_id, pred_idx from pred p join region r using (page_id)
      where r.region_idx = (select m.largest from main m where m.page_id = p.page_id)
      and floor((p.x1 + p.x2) / 2) between least(r.x1, r.x2) and greatest(r.x1, r.x2)
      and floor((p.y1 + p.y2) / 2) between least(r.y1, r.y2) and greatest(r.y1, r.y2)""", """
      main as (select page_id, arg_min(region_idx, {'a': -abs(x2 - x1) * abs(y2 - y1), 'i': region_idx}) as largest from region group by page_id)"""),
)
def region_filter(s: Samples):
    region = page_xml.main_region(region_polygons(s), "page_id", "largest")
    return L.inside_region(s.pred, region, L.box_centre()).select("page_id", "pred_idx")


@check(
    "j14_score_lookup",
    oracle("line pred", """select l.page_id as page_id, l.line_idx as line_idx, coalesce(p.score, 0.0) as score from line l
      left join pred p on p.page_id = l.page_id and p.pred_idx = l.line_idx"""),
)
def score_lookup(s: Samples):
    return L.lookup_scores(s.line.select(*KEYS), s.pred.select("page_id", F.col("pred_idx").alias("line_idx"), "score"), list(KEYS))


@check(
    "p07_score_threshold", oracle("pred", "select page_id, pred_idx from pred where score >= 0.5")
)
def score_threshold(s: Samples):
    return s.pred.filter(F.col("score") >= 0.5).select("page_id", "pred_idx")


# Kept boxes of a page after going through them by y1; a box covered by a kept one replaces it if taller.
SUPPRESS = """
ordered as (select *, row_number() over (partition by page_id order by y1, pred_idx) as step from pred),
kept(page_id, step, boxes) as (
  select page_id, cast(0 as bigint), cast([] as struct(y1 int, y2 int, i int)[]) from ordered where step = 1
  union all
  select k.page_id, o.step, case
      when hit.at is null then list_append(k.boxes, {'y1': o.y1, 'y2': o.y2, 'i': o.pred_idx})
      when o.y2 - o.y1 > k.boxes[hit.at].y2 - k.boxes[hit.at].y1
        then list_concat(list_concat(k.boxes[1:hit.at - 1], [{'y1': o.y1, 'y2': o.y2, 'i': o.pred_idx}]), k.boxes[hit.at + 1:])
      else k.boxes end
  from kept k join ordered o on o.page_id = k.page_id and o.step = k.step + 1,
    lateral (select list_position(list_transform(k.boxes, lambda b: (least(o.y2, b.y2) - greatest(o.y1, b.y1)) / (o.y2 - o.y1 + 1e-6) > 0.95), true) as at) hit),
final as (select page_id, unnest(arg_max(boxes, step)) as b from kept group by page_id)
"""


@check("w04_row_suppression", oracle("pred", "select page_id, b.i as pred_idx from final", SUPPRESS, recursive=True))
def row_suppression(s: Samples):
    return L.suppress_rows(s.pred, 0.95).select("page_id", "pred_idx")
