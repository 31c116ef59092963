"""Metrics and losses (A-03 to A-05, A-09 to A-12, A-14 to A-21, A-23, F-04, F-05, W-06, O-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks import matching
from scriptoria.checks.formats import SPLIT
from scriptoria.checks.registry import check
from scriptoria.functions import scalars as S
from scriptoria.operators import lines as L
from scriptoria.operators import matching as M
from scriptoria.operators import metrics as Q
from scriptoria.operators import selection as sel
from scriptoria.plans import evaluate
from scriptoria.samples import Samples, oracle


@check(
    "a03_subset_summary",
    oracle("line pred file", """select p.manuscript as subset, count(*) as n_images, cast(sum(has_pred) as bigint) as n_prediction_files,
        round(avg(dr), 6) as dr, round(avg(ra), 6) as ra, round(avg(fm), 6) as fm
      from (select *, case when exists (select 1 from file f where f.stem = page.stem and f.kind = 'pred_xml') then 1 else 0 end as has_pred from page) p
      left join (select score.* from score join paired using (page_id)) s on s.page_id = p.page_id group by p.manuscript""",
           matching.SCORED + matching.PAIRED_PAGE, recursive=True),
)
def subset_summary(s: Samples):
    kinds = s.file.groupBy("stem").agg(
        F.max((F.col("kind") == "pred_xml").cast("int")).alias("has_pred"), F.max((F.col("kind") == "gt_xml").cast("int")).alias("has_gt")
    )
    pages = s.page.select("page_id", "stem", "manuscript").join(kinds, "stem")
    both = (F.col("has_pred") == 1) & (F.col("has_gt") == 1)
    rated = pages.join(matching.scores(s).select("page_id", "DR", "RA", "FM"), "page_id", "left")
    return rated.groupBy(F.col("manuscript").alias("subset")).agg(
        F.count(F.lit(1)).alias("n_images"), F.sum("has_pred").alias("n_prediction_files"),
        *[F.round(F.avg(F.when(both, F.col(c))), 6).alias(c.lower()) for c in ("DR", "RA", "FM")],
    )


BINARY_METRICS = """
counts as (select image, count(*) filter (where pred = 1 and gt = 1) as tp, count(*) filter (where pred = 1 and gt <> 1) as fp,
  count(*) filter (where pred <> 1 and gt = 1) as fn from binary_pair group by image),
metrics as (select image, tp / (tp + fp + fn + 1e-6::double) as "IoU", tp / (tp + fp + 1e-6::double) as "Precision",
  tp / (tp + fn + 1e-6::double) as "Recall", 2 * tp / (2 * tp + fp + fn + 1e-6::double) as "F1", 2 * tp / (2 * tp + fp + fn + 1e-6::double) as "Dice" from counts)
"""
NAMES = ("IoU", "Precision", "Recall", "F1", "Dice")
ROUNDED = ", ".join(f'round("{n}", 9) as "{n}"' for n in NAMES)


@check("a04_binary_metrics", oracle("binary_pair", f"select image, {ROUNDED} from metrics", BINARY_METRICS))
def binary_metrics(s: Samples):
    return Q.binary_metrics(s.binary_pair, ["image"]).select("image", *[F.round(n, 9).alias(n) for n in NAMES])


@check("a04_pixel_metrics", oracle("pixel", """select page_id, round(tp / (tp + fp + fn + 1e-6::double), 9) as "IoU" from (
    select page_id, count(*) filter (where prob > 0.5 and mask = 1) as tp, count(*) filter (where prob > 0.5 and mask = 0) as fp,
      count(*) filter (where prob <= 0.5 and mask = 1) as fn from pixel where not dont_care group by page_id) c"""))
def pixel_metrics(s: Samples):
    rows = s.pixel.filter(~F.col("dont_care")).select("page_id", S.binarise(F.col("prob")).alias("pred"), F.col("mask").alias("gt"))
    return Q.binary_metrics(rows, ["page_id"]).select("page_id", F.round("IoU", 9).alias("IoU"))


@check("a05_mean_metrics", oracle("binary_pair", "select " + ", ".join(f'round(avg("{n}"), 9) as "{n}"' for n in NAMES) + " from metrics", BINARY_METRICS))
def mean_metrics(s: Samples):
    return Q.mean_metrics(Q.binary_metrics(s.binary_pair, ["image"]), NAMES).select(*[F.round(n, 9).alias(n) for n in NAMES])


@check("o06_worst_images", oracle("binary_pair", 'select image, round("IoU", 9) as "IoU" from metrics order by metrics."IoU", image limit 3', BINARY_METRICS))
def worst_images(s: Samples):
    found = Q.binary_metrics(s.binary_pair, ["image"]).orderBy("IoU", "image").limit(3)
    return found.select("image", F.round("IoU", 9).alias("IoU"))


@check("a09_corpus_counts", oracle("line page", f"""select manuscript, split, count(*) as pages, cast(sum(n) as bigint) as lines from (
    select manuscript, {SPLIT} as split, coalesce(n, 0) as n from page left join (select page_id, count(*) as n from line group by page_id) l using (page_id)) c
    group by rollup(manuscript, split)"""))
def corpus_counts(s: Samples):
    pages = s.page.select("page_id", "manuscript", S.canonical_split(F.col("split_dir")).alias("split"))
    counts = L.lines_per_page(pages, s.line)
    return Q.corpus_counts(pages.join(counts, "page_id"))


@check("a10_lines_per_page", oracle("pred page", "select page_id, coalesce(n, 0) as n_lines from page left join (select page_id, count(*) as n from pred group by page_id) p using (page_id)"))
def lines_per_page(s: Samples):
    return L.lines_per_page(s.page, s.pred)


@check("a11_score_range", oracle("pred", "select page_id, min(score) as min_score, max(score) as max_score, count(*) as n from pred group by page_id"))
def score_range(s: Samples):
    return s.pred.groupBy("page_id").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n"))


@check("a12_segment_variance", oracle("pixel", """select page_id, round(avg(power(prob - m, 2)), 9) as variance from (
    select *, sum(prob) over (partition by page_id, sp_id) / (count(*) over (partition by page_id, sp_id) + 1e-6::double) as m from pixel) d group by page_id"""))
def segment_variance(s: Samples):
    return Q.segment_variance(s.pixel).withColumn("variance", F.round("variance", 9))


def held(p: str) -> str:
    return f"least(greatest({p}, 1e-6::double), 1 - 1e-6::double)"


LOSS = f"avg(-(m * ln({held('p')}) + (1 - m) * ln(1 - {held('p')}))) + 1.0 - (2.0 * sum(p * m) + 1.0) / (sum(p) + sum(m) + 1.0)"


@check("a14_segmentation_loss", oracle("pixel", f"""select page_id, round(coalesce({LOSS}, 0.0), 7) as loss from (
    select page_id, case when not dont_care then prob end as p, case when not dont_care then mask end as m from pixel) v group by page_id"""))
def segmentation_loss(s: Samples):
    return Q.segmentation_loss(s.pixel, ~F.col("dont_care"), ["page_id"]).withColumn("loss", F.round("loss", 7))


@check("a15_per_image_dice", oracle("pixel", f"""select round(1 - avg((2 * i + 1e-6::double) / (t + 1e-6::double)), 9) as dice_loss,
    round(0.5::double * (sum(b) / sum(n)) + 0.5::double * (1 - avg((2 * i + 1e-6::double) / (t + 1e-6::double))), 9) as loss from (
    select page_id, sum(prob * mask) as i, sum(prob) + sum(mask) as t, sum(-(mask * ln({held('prob')}) + (1 - mask) * ln(1 - {held('prob')}))) as b, count(*) as n from pixel group by page_id) g"""))
def per_image_dice(s: Samples):
    return Q.per_image_dice_loss(s.pixel).select(F.round("dice_loss", 9).alias("dice_loss"), F.round("loss", 9).alias("loss"))


@check("a16_boundary_loss", oracle("pixel", f"select page_id, round(coalesce(avg(-ln(1 - {held('prob')})) filter (where boundary), 0.0), 7) as loss from pixel group by page_id"))
def boundary_loss(s: Samples):
    return Q.boundary_loss(s.pixel, ["page_id"]).withColumn("loss", F.round("loss", 7))


@check("a17_pseudo_loss", oracle("pixel", f"""select page_id, round(coalesce({LOSS}, 0.0), 7) as loss from (
    select page_id, case when prob > 0.9 then prob end as p, case when prob > 0.9 then (case when prob > 0.5 then 1 else 0 end) end as m from pixel) v group by page_id"""))
def pseudo_loss(s: Samples):
    return Q.pseudo_loss(s.pixel, 0.9, ["page_id"]).withColumn("loss", F.round("loss", 7))


@check("a18_pooled_iou", oracle("pixel", """select round(count(*) filter (where prob > 0.5 and mask = 1) / (count(*) filter (where prob > 0.5 or mask = 1) + 1e-6::double), 9) as iou from pixel"""))
def pooled_iou(s: Samples):
    return Q.pooled_iou(s.pixel).withColumn("iou", F.round("iou", 9))


@check("a19_epoch_means", oracle("epoch", "select run, round(sum(loss * batch_size) / sum(batch_size), 7) as loss, round(sum(val_iou * batch_size) / sum(batch_size), 7) as val_iou from epoch group by run"))
def epoch_means(s: Samples):
    return Q.weighted_means(s.epoch, ["run"], ["loss", "val_iou"]).select("run", F.round("loss", 7).alias("loss"), F.round("val_iou", 7).alias("val_iou"))


@check("a20_model_comparison", oracle("epoch", "select method as model, cast(round_even(max(val_iou), 4) as double) as val_iou, cast(round_even(min(loss), 4) as double) as loss from epoch group by method"))
def model_comparison(s: Samples):
    rows = s.epoch.groupBy(F.col("method").alias("model")).agg(F.max("val_iou").alias("val_iou"), F.min("loss").alias("loss"))
    return Q.comparison_table(rows, ["val_iou", "loss"], "val_iou")


# Shots per method from the ranked runs of each method.
SWEEP = """
run_score as (select method, run, avg(val_iou) as v from epoch group by method, run),
ranked as (select method, run, v, row_number() over (partition by method order by md5(concat('7|', cast(run as varchar))), run) as rank from run_score)
"""


@check("a21_shot_sweep", oracle("epoch", """select method, k, round(avg(v), 7) as mean_dice, count(*) as n from ranked, (select unnest([1, 2, 5, 10]) as k) s
    where rank <= k group by method, k""", SWEEP))
def shot_sweep(s: Samples):
    runs = s.epoch.groupBy("method", "run").agg(F.avg("val_iou").alias("v"))
    ranked = sel.random_pages(runs, 10, seed=7, key="run", by=["method"])
    swept = sel.shot_sweep(ranked, (1, 2, 5, 10))
    return swept.groupBy("method", "k").agg(F.round(F.avg("v"), 7).alias("mean_dice"), F.count(F.lit(1)).alias("n"))


@check("w06_improvements", oracle("epoch", """select run, epoch, val_iou > greatest(coalesce(max(val_iou) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 0.0), 0.0) as improved from epoch"""))
def improvements(s: Samples):
    return Q.improvements(s.epoch, ["run"], "val_iou", 0.0).select("run", "epoch", "improved")


@check("w06_best_epoch", oracle("epoch", "select run, epoch, val_iou from (select *, row_number() over (partition by run order by val_iou desc, epoch) as k from epoch) r where k = 1"))
def best_epoch(s: Samples):
    return Q.best_epoch(s.epoch, ["run"], "val_iou")


@check("f04_half_even", oracle("line pred", "select page_id, cast(round_even(n / 32.0::double, 4) as double) as four, cast(round_even(n / 32.0::double, 2) as double) as two from (select page_id, count(*) as n from pred group by page_id) c"))
def half_even(s: Samples):
    share = F.col("n") / 32.0
    counts = s.pred.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("page_id", S.half_even(share, 4).alias("four"), S.half_even(share, 2).alias("two"))


@check("f05_sigmoid_logit", oracle("pixel", "select page_id, px, round(ln(greatest(least(prob, 1 - 1e-6::double), 1e-6::double) / (1 - greatest(least(prob, 1 - 1e-6::double), 1e-6::double))), 8) as logit, round(1 / (1 + exp(-prob)), 8) as sigmoid from pixel"))
def sigmoid_logit(s: Samples):
    return s.pixel.select("page_id", "px", F.round(S.logit(F.col("prob")), 8).alias("logit"), F.round(S.sigmoid(F.col("prob")), 8).alias("sigmoid"))


# No two lines compete for one prediction here, so the best-scored candidate of a line is its match.
DETECTION = matching.PAIRS + """,
level as (select unnest(range(10)) as i),
hit as (
  select i, o.page_id as page_id, o.gt_idx as gt_idx, arg_min(o.pred_idx, {'s': -p.score, 'p': o.pred_idx}) as pred_idx
  from overlap o join pred p on p.page_id = o.page_id and p.pred_idx = o.pred_idx, level where iou >= (50 + 5 * i) / 100.0::double group by i, o.page_id, o.gt_idx),
flagged as (select l.i as i, p.score as score, case when h.pred_idx is not null then 1 else 0 end as tp
  from pred p cross join level l left join hit h on h.i = l.i and h.page_id = p.page_id and h.pred_idx = p.pred_idx),
steps as (select i, score, sum(tp) as tp, count(*) as n from flagged group by i, score),
curve as (select i, score, sum(tp) over w / sum(n) over w as prec, sum(tp) over w / (select count(*) from line) as rec from steps window w as (partition by i order by score desc)),
env as (select *, max(prec) over (partition by i order by score) as envelope, coalesce(lag(rec) over (partition by i order by score desc), 0.0) as before from curve),
ap as (select i, sum((rec - before) * envelope) as ap from env group by i),
best as (select prec, rec from curve where i = 0 order by round(2 * prec * rec / (prec + rec + 1e-16::double), 9) desc, score desc limit 1)
"""


@check("a23_average_precision", oracle("line pred", """select round((select ap from ap where i = 0), 7) as map50, round((select avg(ap) from ap), 7) as map50_95,
    round((select prec from best), 7) as "precision", round((select rec from best), 7) as recall""", DETECTION))
def average_precision(s: Samples):
    found = evaluate.detection_scores(matching.gt_boxes(s), s.pred)
    return found.select(*(F.round(c, 7).alias(c) for c in ("map50", "map50_95", "precision", "recall")))
