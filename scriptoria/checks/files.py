"""Listings, names, splits and joins of files (S-01, S-02, P-01 to P-03, J-01 to J-04, U-*, F-*, O-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks.registry import check
from scriptoria.functions import scalars as S
from scriptoria.operators import joins
from scriptoria.samples import Samples, oracle
from scriptoria.sources import files as sources

STEM = "regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '')"
EXT = "regexp_extract(path, '(\\.[^./]*)$', 1)"
IS_IMAGE = "regexp_matches(lower(path), '\\.(jpg|jpeg|png|tif|tiff)$')"
RANK = "case lower(" + EXT + ") when '.jpg' then 0 when '.jpeg' then 1 when '.png' then 2 when '.tif' then 3 when '.tiff' then 4 end"


@check(
    "s01_list_images",
    oracle("file", f"select path, regexp_extract(path, '[^/]+$') as name, {STEM} as stem_name, {EXT} as extension from file where {IS_IMAGE}"),
)
def list_images(s: Samples):
    return sources.list_images(s.file).select("path", "name", "stem_name", "extension")


ALIASES = """
alias(kind, split, folder, priority) as (values
  ('img', 'train', 'train', 0), ('img', 'train', 'training', 1), ('img', 'val', 'val', 0), ('img', 'val', 'validation', 1),
  ('img', 'test', 'test', 0),
  ('gt', 'train', 'training', 0), ('gt', 'train', 'train', 1), ('gt', 'val', 'validation', 0), ('gt', 'val', 'val', 1),
  ('gt', 'test', 'test', 0)),
located as (
  select case kind when 'image' then 'img' when 'gt_png' then 'gt' end as kind,
    regexp_extract(path, '([^/]+)/[^/]+$', 1) as folder, path from file where kind in ('image', 'gt_png')),
best as (
  select a.kind as kind, a.split as split, arg_min(a.folder, a.priority) as folder
  from alias a where exists (select 1 from located l where l.kind = a.kind and l.folder = a.folder) group by a.kind, a.split)
"""


@check(
    "s02_resolve_splits",
    oracle("file", "select b.kind as kind, b.split as split, b.folder as folder, l.path as path from best b join located l using (kind, folder)", ALIASES),
)
def resolve_splits(s: Samples):
    located = s.file.select(
        F.when(F.col("kind") == "image", "img").when(F.col("kind") == "gt_png", "gt").alias("kind"),
        F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "path",
    ).filter("kind is not null")
    aliases = sources.alias_table(s.spark, "u_diads_coco")
    chosen = sources.resolve_splits(located, aliases, required=["img", "gt"])
    return located.join(F.broadcast(chosen.select("kind", "split", "folder")), ["kind", "folder"]).select("kind", "split", "folder", "path")


@check(
    "p01_canonical_split",
    oracle("page", """select page_id, case when split_dir in ('train', 'training') then 'train'
      when split_dir in ('val', 'validation') then 'val' else 'test' end as split from page"""),
)
def canonical_split(s: Samples):
    return s.page.select("page_id", S.canonical_split(F.col("split_dir")).alias("split"))


BEST_IMAGE = f"best_image as (select stem, arg_min(path, {RANK}) as path from file where kind = 'image' group by stem)"


@check("p02_one_image_per_stem", oracle("file", "select stem, path from best_image", BEST_IMAGE))
def one_image_per_stem(s: Samples):
    return sources.one_image_per_stem(s.file.filter("kind = 'image'"))


@check(
    "p03_include_stems",
    oracle("line page", """select page_id, count(*) as n_lines from line
      where page_id in (select page_id from page where priority = '1-URGENT') group by page_id"""),
)
def include_stems(s: Samples):
    wanted = s.page.filter("priority = '1-URGENT'").select("page_id")
    return s.line.join(wanted, "page_id", "left_semi").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))


@check(
    "j01_image_with_annotation",
    oracle("file", """select i.stem as stem, i.path as image, x.path as xml from best_image i
      join file x on x.stem = i.stem and x.kind = 'gt_xml'""", BEST_IMAGE),
)
def image_with_annotation(s: Samples):
    images = sources.one_image_per_stem(s.file.filter("kind = 'image'")).withColumnRenamed("path", "image")
    xml = s.file.filter("kind = 'gt_xml'").select("stem", F.col("path").alias("xml"))
    return images.join(xml, "stem")


@check(
    "j02_missing_partner",
    oracle("file", """
      select distinct stem, 'no_annotation' as problem from file f where kind = 'image'
        and not exists (select 1 from file x where x.stem = f.stem and x.kind = 'gt_xml')
      union all
      select stem, 'no_prediction' from file f where kind = 'gt_xml'
        and not exists (select 1 from file x where x.stem = f.stem and x.kind = 'pred_xml')"""),
)
def missing_partner(s: Samples):
    of = lambda kind: s.file.filter(F.col("kind") == kind).select("stem").distinct()
    no_xml = of("image").join(of("gt_xml"), "stem", "left_anti").withColumn("problem", F.lit("no_annotation"))
    no_pred = of("gt_xml").join(of("pred_xml"), "stem", "left_anti").withColumn("problem", F.lit("no_prediction"))
    return no_xml.unionByName(no_pred)


@check(
    "j03_complete_pages",
    oracle("file", """select p.stem as stem, i.path as image, x.path as gt_xml, g.path as gt_png, p.path as pred_xml
      from file p join best_image i on i.stem = p.stem join file x on x.stem = p.stem and x.kind = 'gt_xml'
      join file g on g.stem = p.stem and g.kind = 'gt_png' where p.kind = 'pred_xml'""", BEST_IMAGE),
)
def complete_pages(s: Samples):
    images = sources.one_image_per_stem(s.file.filter("kind = 'image'")).withColumn("kind", F.lit("image"))
    others = s.file.filter("kind <> 'image'").select("stem", "path", "kind")
    return joins.complete_pages(images.unionByName(others), ["image", "gt_xml", "gt_png", "pred_xml"])


@check(
    "j04_contains_join",
    oracle("linemask page", "select m.path as path, p.page_id as page_id from linemask m join page p on contains(m.path, p.stem)"),
)
def contains_join(s: Samples):
    masks = s.linemask.select("path", S.basename(F.col("path")).alias("name"))
    return joins.contains_join(masks, s.page.select("page_id", "stem"), "name", "stem").select("path", "page_id")


@check(
    "u01_union_frames",
    oracle("metric epoch", """select event_id as id, dr_text as value from metric
      union all select run, cast(val_iou as varchar) from epoch"""),
)
def union_frames(s: Samples):
    first = s.metric.select(F.col("event_id").alias("id"), F.col("dr_text").alias("value"))
    second = s.epoch.select(F.col("val_iou").cast("string").alias("value"), F.col("run").alias("id"))
    return first.unionByName(second)


@check("u02_distinct_stems", oracle("file", f"select distinct {STEM} as stem from file where {IS_IMAGE}"))
def distinct_stems(s: Samples):
    return s.file.filter(S.has_extension(F.col("path"))).select(S.stem(F.col("path")).alias("stem")).distinct()


@check(
    "u03_train_minus_labeled",
    oracle("page", """select stem from page where split_dir in ('train', 'training')
      except select stem from page where priority = '1-URGENT'"""),
)
def train_minus_labeled(s: Samples):
    train = s.page.filter(S.canonical_split(F.col("split_dir")) == "train").select("stem")
    return train.join(s.page.filter("priority = '1-URGENT'").select("stem"), "stem", "left_anti")


@check(
    "u04_union_of_globs",
    oracle("file", " union all ".join(f"select path from file where path like '%{e}'" for e in (".jpg", ".png", ".tif", ".tiff"))),
)
def union_of_globs(s: Samples):
    wanted = S.has_extension(F.col("path"), (".jpg", ".png", ".tif", ".tiff"), ignore_case=False)
    return s.file.filter(wanted).select("path")


@check("f01_names", oracle("file", f"select path, regexp_extract(path, '[^/]+$') as name, {STEM} as stem_name, {EXT} as extension from file"))
def names(s: Samples):
    p = F.col("path")
    return s.file.select("path", S.basename(p).alias("name"), S.stem(p).alias("stem_name"), S.extension(p).alias("extension"))


@check("f02_has_extension", oracle("file", "select path, regexp_matches(lower(path), '\\.(jpg|png|jpeg|tif)$') as is_image from file"))
def has_extension(s: Samples):
    return s.file.select("path", S.has_extension(F.col("path"), (".jpg", ".png", ".jpeg", ".tif")).alias("is_image"))


@check(
    "f08_run_name",
    oracle("epoch", "select distinct concat_ws('_', 'scan', method, cast(run as varchar), 'best') as run_name from epoch"),
)
def run_name(s: Samples):
    return s.epoch.select(S.run_name(F.lit("scan"), F.col("method"), F.col("run").cast("string"), F.lit("best")).alias("run_name")).distinct()


@check(
    "o04_natural_sort",
    oracle("linemask", """select path, cast(row_number() over (partition by page_id order by
      list_filter(flatten(list_transform(list_zip(string_split_regex(path, '[0-9]+'), regexp_extract_all(path, '[0-9]+')),
        lambda z: [z[1], case when z[2] is not null then lpad(cast(cast(z[2] as bigint) as varchar), 19, '0') end])), lambda p: p is not null), path) as int) as place from named""",
      """named as (select page_id, path from linemask union all select m.page_id, x.name || cast(m.page_id % 3 as varchar) as path
        from (select distinct page_id from linemask) m, (values ('page'), ('page-'), ('page '), ('page1.'), ('page10.'), ('page2.'), ('page02')) x(name))"""),
)
def natural_sort(s: Samples):
    from scriptoria.operators.scan import row_numbers

    # names that differ in where digits begin, next to those of the masks
    stems = F.explode(F.array(*[F.lit(n) for n in ("page", "page-", "page ", "page1.", "page10.", "page2.", "page02")]))
    odd = s.linemask.select("page_id").distinct().select("page_id", stems.alias("stem")).select("page_id", F.concat("stem", (F.col("page_id") % 3).cast("string")).alias("path"))
    keyed = s.linemask.select("page_id", "path").unionByName(odd).withColumn("key", S.natural_key(F.col("path")))
    return row_numbers(keyed, ["page_id"], [F.col("key"), F.col("path")], "place").select("path", "place")
