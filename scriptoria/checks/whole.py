"""End-to-end plans over the derived tables (A-01 on polygons and masks, X-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks import matching
from scriptoria.checks.raster import component_sql, mask_rows
from scriptoria.checks.registry import check
from scriptoria.functions import geometry as G
from scriptoria.operators.scan import spread
from scriptoria.plans import evaluate
from scriptoria.samples import Samples, oracle


@check(
    "a01_polygon_page_score",
    oracle(
        "line pred",
        'select page_id, n_gt as "N_gt", n_pred as "N_pred", m as "M", dr as "DR", ra as "RA", fm as "FM" from score',
        matching.SCORED, recursive=True,
    ),
)
def polygon_page_score(s: Samples):
    box = G.box_polygon(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return evaluate.score_polygon_lines(s.sides.select("page_id", "truth", "idx", box.alias("points")), most=s.most_lines)


# Lines and predictions that overshoot a page of 400 x 200 pixels; pixels outside do not exist.
BOUNDED = """
gbox as (select page_id, line_idx, x1 - 80 as x1, y1 - 20 as y1, x2 - 80 as x2, y2 - 20 as y2 from line),
pbox as (select page_id, pred_idx, case when x1 < 80 then x1 - 180 else x1 - 80 end as x1, y1 - 20 as y1,
  case when x2 > 470 then x2 + 120 else x2 - 80 end as x2, y2 - 20 as y2 from pred),
gclip as (select page_id, line_idx, greatest(x1, 0) as x1, greatest(y1, 0) as y1, least(x2, 399) as x2, least(y2, 199) as y2 from gbox
  where x2 >= 0 and y2 >= 0 and x1 < 400 and y1 < 200),
pclip as (select page_id, pred_idx, greatest(x1, 0) as x1, greatest(y1, 0) as y1, least(x2, 399) as x2, least(y2, 199) as y2 from pbox
  where x2 >= 0 and y2 >= 0 and x1 < 400 and y1 < 200),
""" + matching.SCORED.replace("from line g join pred p", "from gclip g join pclip p").replace("from line group", "from gbox group").replace("from pred group", "from pbox group").strip()


@check(
    "a01_bounded_page_score",
    oracle("line pred", 'select page_id, n_gt as "N_gt", n_pred as "N_pred", m as "M", dr as "DR", ra as "RA", fm as "FM" from score', BOUNDED, recursive=True),
)
def bounded_page_score(s: Samples):
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    lines = s.sides.selectExpr("page_id", "truth", "idx", "case when not truth and x1 < 80 then x1 - 180 else x1 - 80 end as x1", "y1 - 20 as y1",
                               "case when not truth and x2 > 470 then x2 + 120 else x2 - 80 end as x2", "y2 - 20 as y2")
    size = s.page.select("page_id", F.lit(400).alias("width"), F.lit(200).alias("height"))
    return evaluate.score_polygon_lines(lines.withColumn("points", G.box_polygon(*corners)), size=size, most=s.most_lines)


@check(
    "a01_mask_page_score",
    oracle("grid", """select page_id, cast(n_gt as bigint) as "N_gt", cast(n_pred as bigint) as "N_pred", cast(coalesce(m, 0) as bigint) as "M",
        cast(round_even(coalesce(m, 0) / cast(n_gt as double), 2) as double) as "DR" from (
        select page_id, count(distinct comp) as n_gt from gt_comp group by page_id) g
      join (select page_id, count(distinct comp) as n_pred from pr_comp group by page_id) p using (page_id)
      left join (select page_id, count(*) as m from (
        select i.page_id as page_id, cast(i.n as double) / (a.n + b.n - i.n) as iou
        from (select a.page_id as page_id, a.comp as g, b.comp as p, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) as n
          from gt_comp a join pr_comp b on a.page_id = b.page_id and a.y = b.y and a.x0 <= b.x1 and b.x0 <= a.x1 group by a.page_id, a.comp, b.comp) i
        join (select page_id, comp, sum(x1 - x0 + 1) as n from gt_comp group by page_id, comp) a on a.page_id = i.page_id and a.comp = i.g
        join (select page_id, comp, sum(x1 - x0 + 1) as n from pr_comp group by page_id, comp) b on b.page_id = i.page_id and b.comp = i.p) o
        where iou >= 0.75 group by page_id) m using (page_id)""", component_sql("gt", "mask = 1") + "," + component_sql("pr", "mask <> flip"), recursive=True),
)
def mask_page_score(s: Samples):
    scored = evaluate.score_mask_rows(mask_rows(s), most=s.most_pixels)
    return scored.select("page_id", "N_gt", "N_pred", "M", "DR")


@check("x03_lines_from_probabilities")
def lines_from_probabilities(s: Samples):
    return evaluate.lines_from_probability_rows(s.grid_rows(prob="prob"), s.grid_size, 0.5, min_area=20)
