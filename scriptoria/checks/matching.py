"""Pairs, matches and page scores (J-05 to J-09, J-14, A-01, A-02, A-23, W-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks.registry import check
from scriptoria.operators import matching as M
from scriptoria.operators import pages as P
from scriptoria.samples import Samples, oracle

PAIRS = """
pair as (
  select g.page_id as page_id, g.line_idx as gt_idx, p.pred_idx as pred_idx,
    cast((least(g.x2, p.x2) - greatest(g.x1, p.x1) + 1) as bigint) * (least(g.y2, p.y2) - greatest(g.y1, p.y1) + 1) as inter,
    cast(g.x2 - g.x1 + 1 as bigint) * (g.y2 - g.y1 + 1) + cast(p.x2 - p.x1 + 1 as bigint) * (p.y2 - p.y1 + 1) as areas
  from line g join pred p on g.page_id = p.page_id
    and g.x1 <= p.x2 and p.x1 <= g.x2 and g.y1 <= p.y2 and p.y1 <= g.y2),
overlap as (select page_id, gt_idx, pred_idx, inter, areas - inter as uni, cast(inter as double) / (areas - inter) as iou from pair)
"""

# Going through the lines of all pages in order: step k decides line k of every page.
GREEDY = PAIRS + """,
chosen(page_id, step, used, gt_idx, pred_idx, iou) as (
  select page_id, 0, cast([] as integer[]), cast(null as integer), cast(null as integer), cast(null as double)
  from (select distinct page_id from overlap where iou >= 0.75) d
  union all
  select page_id, step, case when best is null then used else list_append(used, best.p) end,
    step - 1, best.p, -best.c
  from (
    select c.page_id as page_id, c.step + 1 as step, any_value(c.used) as used,
      min({'c': -o.iou, 'p': o.pred_idx}) filter (where o.iou >= 0.75 and not list_contains(c.used, o.pred_idx)) as best
    from chosen c left join overlap o on o.page_id = c.page_id and o.gt_idx = c.step
    where c.step <= (select max(gt_idx) from overlap)
    group by c.page_id, c.step) s),
matched as (select page_id, gt_idx, pred_idx, iou from chosen where pred_idx is not null)
"""

SCORED = GREEDY + """,
totals as (
  select page_id, cast(sum(g) as bigint) as n_gt, cast(sum(p) as bigint) as n_pred, cast(sum(m) as bigint) as m from (
    select page_id, count(*) as g, 0 as p, 0 as m from line group by page_id
    union all select page_id, 0, count(*), 0 from pred group by page_id
    union all select page_id, 0, 0, count(*) from matched group by page_id) u
  group by page_id),
rated as (
  select *, case when n_gt > 0 and n_pred > 0 then m / n_gt else 0.0 end as dr,
    case when n_gt > 0 and n_pred > 0 then m / n_pred else 0.0 end as ra from totals),
score as (
  select page_id, n_gt, n_pred, m, cast(round_even(dr, 4) as double) as dr, cast(round_even(ra, 4) as double) as ra,
    cast(round_even(case when dr + ra > 0 then 2 * dr * ra / (dr + ra) else 0.0 end, 4) as double) as fm from rated)
"""


def gt_boxes(s: Samples):
    return s.line.withColumnRenamed("line_idx", "gt_idx")


def paired(s: Samples, shape=None):
    """Lines and predictions by page, with what is known of their number."""
    return P.Sides(s.sides, shape or P.Boxes(), s.most_lines)


def scores(s: Samples):
    return M.score_counts(paired(s).totals(0.75))


@check("j05_candidate_pairs", oracle("line pred", "select page_id, gt_idx, pred_idx from overlap", PAIRS))
def candidate_pairs(s: Samples):
    return M.candidate_pairs(gt_boxes(s), s.pred).select("page_id", "gt_idx", "pred_idx")


@check(
    "j06_box_iou",
    oracle("line pred", "select page_id, gt_idx, pred_idx, inter, uni as \"union\", round(iou, 6) as iou from overlap", PAIRS),
)
def box_iou(s: Samples):
    found = M.box_overlap(M.candidate_pairs(gt_boxes(s), s.pred))
    return found.withColumn("iou", F.round("iou", 6))


@check(
    "j07_greedy_match",
    oracle("line pred", "select page_id, gt_idx, pred_idx, round(iou, 6) as iou from matched", GREEDY, recursive=True),
)
def greedy(s: Samples):
    return paired(s).matches(0.75).withColumn("iou", F.round("iou", 6))


@check(
    "a01_page_score",
    oracle(
        "line pred",
        'select page_id, n_gt as "N_gt", n_pred as "N_pred", m as "M", dr as "DR", ra as "RA", fm as "FM" from score',
        SCORED,
        recursive=True,
    ),
)
def page_score(s: Samples):
    return scores(s)


# Pages count for the corpus only with both annotation files present.
PAIRED_PAGE = """,
paired as (
  select p.page_id as page_id, p.manuscript as manuscript from page p
  where exists (select 1 from file f where f.stem = p.stem and f.kind = 'gt_xml')
    and exists (select 1 from file f where f.stem = p.stem and f.kind = 'pred_xml')
    and exists (select 1 from file f where f.stem = p.stem and f.kind = 'image'))
"""


@check(
    "a02_corpus_score",
    oracle(
        "line pred file",
        """select cast(count(*) as bigint) as pages, round(avg(dr), 6) as mean_dr, round(avg(ra), 6) as mean_ra,
          round(avg(fm), 6) as mean_fm from score join paired using (page_id)""",
        SCORED + PAIRED_PAGE,
        recursive=True,
    ),
)
def corpus_score(s: Samples):
    kinds = s.file.groupBy("stem").agg(F.collect_set("kind").alias("kinds"))
    complete = kinds.filter(F.size(F.array_intersect("kinds", F.array(*map(F.lit, ("gt_xml", "pred_xml", "image"))))) == 3)
    pages = s.page.select("page_id", "stem").join(complete, "stem", "left_semi")
    # a page's score is one small row: scores are joined, not the lines of the pages
    out = M.corpus_score(scores(s).join(pages.select("page_id"), "page_id", "left_semi"))
    return out.select("pages", *[F.round(f"mean_{c}", 6).alias(f"mean_{c.lower()}") for c in ("DR", "RA", "FM")])
