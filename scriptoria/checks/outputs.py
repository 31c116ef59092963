"""What goes into files (S-03, K-07 to K-11, F-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks.formats import SPLIT
from scriptoria.checks.registry import check
from scriptoria.checks.results import BINARY_METRICS, NAMES, ROUNDED
from scriptoria.functions import scalars as S
from scriptoria.operators import metrics as Q
from scriptoria.samples import Samples, oracle
from scriptoria.sources import files as sources
from scriptoria.sources import page_xml, tables


@check("s03_page_size", oracle("page", "select page_id, width, height from page"))
def page_size(s: Samples):
    element = F.concat(
        F.lit('<Page imageFilename="'), "stem", "ext", F.lit('" imageWidth="'), F.col("width").cast("string"),
        F.lit('" imageHeight="'), F.col("height").cast("string"), F.lit('"></Page>'),
    )
    return s.page.select("page_id", page_xml.page_size(element).alias("size")).select("page_id", "size.*")


MEANS = ", ".join(f'round(avg("{n}"), 9)' for n in NAMES)


@check(
    "k07_metric_rows",
    oracle("binary_pair", f"select image, {ROUNDED} from metrics union all select 'mean', {MEANS} from metrics", BINARY_METRICS),
)
def metric_rows(s: Samples):
    rows = Q.binary_metrics(s.binary_pair, ["image"])
    both = rows.unionByName(Q.mean_metrics(rows, NAMES).withColumn("image", F.lit("mean")))
    return both.select("image", *[F.round(n, 9).alias(n) for n in NAMES])


@check(
    "k08_dataset_descriptor",
    oracle("page", f"""select manuscript, split, concat(manuscript, '/images/', split) as images, count(*) as n_images
      from (select manuscript, {SPLIT} as split from page) p group by manuscript, split"""),
)
def dataset_descriptor(s: Samples):
    splits = s.page.groupBy("manuscript", S.canonical_split(F.col("split_dir")).alias("split")).agg(F.count(F.lit(1)).alias("n_images"))
    return splits.select("manuscript", "split", F.concat_ws("/", "manuscript", F.lit("images"), "split").alias("images"), "n_images")


@check(
    "k09_new_images",
    oracle("file", """select stem, path from file i where kind = 'image'
      and not exists (select 1 from file d where d.stem = i.stem and d.kind = 'gt_png')"""),
)
def new_images(s: Samples):
    # Images with a mask stand for the ones already copied.
    held = tables.output_stems(s.file.filter("kind = 'gt_png'"))
    return s.file.filter("kind = 'image'").join(held, "stem", "left_anti").select("stem", "path")


@check(
    "k10_missing_outputs",
    oracle("file", "select distinct stem from file g where kind = 'gt_xml' and stem not in (select stem from file where kind = 'pred_xml')"),
)
def missing_outputs(s: Samples):
    done = tables.output_stems(s.file.filter("kind = 'pred_xml'"))
    wanted = sources.list_images(s.file.filter("kind = 'gt_xml'"), (".xml",)).select(F.col("stem_name").alias("stem")).distinct()
    return wanted.join(done, "stem", "left_anti")


@check(
    "k11_probability_levels",
    oracle("grid", """select page_id, cast(sum(cast(floor(least(greatest(prob * 255, 0.0), 255.0)) as int)) as bigint) as total,
      count(*) filter (where prob > 0.5) as text from grid group by page_id"""),
)
def probability_levels(s: Samples):
    return s.grid.groupBy("page_id").agg(
        F.sum(tables.probability_level(F.col("prob"))).alias("total"), F.count_if(F.col("prob") > 0.5).alias("text")
    )


@check("f06_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as created from events")
def timestamps(s: Samples):
    return s.raw("events").select("event_id", S.iso_timestamp(F.col("ts")).alias("created"))
