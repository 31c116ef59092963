"""Selection, pairing, batches and memory (O-01 to O-03, O-05, O-07, J-10, J-11, J-13, W-05, W-08, T-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.checks.registry import check
from scriptoria.functions import scalars as S
from scriptoria.operators import memory
from scriptoria.operators import selection as sel
from scriptoria.samples import Samples, oracle

VARIANCE = "v as (select stem, manuscript, round(var_pop((299 * red + 587 * green + 114 * blue + 500) // 1000), 6) as variance from grid join page using (page_id) group by stem, manuscript)"


def variances(s: Samples):
    pages = s.page.select("page_id", "stem", "manuscript")
    found = sel.page_variance(s.grid).withColumn("variance", F.round("variance", 6))
    return pages.join(found, "page_id")


@check("o01_top_by_variance", oracle("grid page", "select stem, variance from v order by v.variance desc, stem limit 10", VARIANCE))
def top_by_variance(s: Samples):
    return sel.top_by_variance(variances(s), 10).select("stem", "variance")


@check("o01_top_per_manuscript", oracle("grid page", """select manuscript, cast(rank as int) as rank, stem from (
    select *, row_number() over (partition by manuscript order by variance desc, stem) as rank from v) r where rank <= 5""", VARIANCE))
def top_per_manuscript(s: Samples):
    return sel.top_by_variance(variances(s), 5, by=["manuscript"]).select("manuscript", "rank", "stem")


@check("o02_random_pages", oracle("page", "select stem from page order by md5(concat('42|', stem)), stem limit 20"))
def random_pages(s: Samples):
    return sel.random_pages(s.page, 20, 42).select("stem")


@check("o03_select_labeled", oracle("page", "select stem from page order by md5(concat('5|', stem)), stem limit 7"))
def select_labeled(s: Samples):
    return sel.select_labeled(s.spark, s.page, 7, "random", None, 5)


@check("o05_random_page", oracle("page", "select stem from page order by md5(concat('1|', stem)), stem limit 1"))
def random_page(s: Samples):
    return sel.random_pages(s.page, 1, 1).select("stem")


@check("o07_shot_sweep", oracle("page", """select manuscript, k, stem from (
    select *, row_number() over (partition by manuscript order by md5(concat('42|', stem)), stem) as rank from page) r, (select unnest([1, 2, 5, 10]) as k) s where rank <= k"""))
def shot_sweep(s: Samples):
    ranked = sel.random_pages(s.page, 10, 42, by=["manuscript"])
    return sel.shot_sweep(ranked).select("manuscript", "k", "stem")


TRAIN = "split_dir in ('train', 'training')"


@check("j10_split_labeled", oracle("page", f"""select stem, case when priority = '1-URGENT' then 'labeled' else 'unlabeled' end as part from page where {TRAIN}"""))
def split_labeled(s: Samples):
    train = s.page.filter(S.canonical_split(F.col("split_dir")) == "train").select("stem")
    labeled, unlabeled = sel.split_labeled(train, s.page.filter("priority = '1-URGENT'").select("stem"))
    return labeled.withColumn("part", F.lit("labeled")).unionByName(unlabeled.withColumn("part", F.lit("unlabeled")))


@check("j11_cyclic_pairs", oracle("page", f"""select u.i as i, l.stem as labeled, u.stem as unlabeled
    from (select stem, row_number() over (order by stem) - 1 as i from page where {TRAIN} and priority <> '1-URGENT') u
    join (select stem, row_number() over (order by stem) - 1 as k, count(*) over () as n from page where {TRAIN} and priority = '1-URGENT') l on l.k = u.i % l.n"""))
def cyclic_pairs(s: Samples):
    train = s.page.filter(S.canonical_split(F.col("split_dir")) == "train").select("stem")
    labeled, unlabeled = sel.split_labeled(train, s.page.filter("priority = '1-URGENT'").select("stem"))
    return sel.cyclic_pairs(labeled, unlabeled)


@check("w08_batch_plan", oracle("page", """select stem, place, cast(floor(place / 16) as bigint) as batch from (
    select stem, row_number() over (order by md5(concat('3|1|', stem)), stem) - 1 as place, count(*) over () as n from page) p where n < 16 or floor(place / 16) < n // 16"""))
def batch_plan(s: Samples):
    return sel.batch_plan(s.page.select("stem"), 16, seed=3, epoch=1)


PROTOTYPE = """
proto as (select label, arg_min(embedding, vec_id) as embedding from vector group by label),
scored as (select v.vec_id as vec_id, p.label as cls, list_cosine_similarity(cast(v.embedding as double[]), cast(p.embedding as double[])) as c from vector v, proto p)
"""


@check("j13_assign_class", oracle("vector", """select vec_id, cast(cls as bigint) as cls, round(c, 6) as similarity from (
    select *, row_number() over (partition by vec_id order by c desc, cls) as k from scored) r where k = 1""", PROTOTYPE))
def assign_class(s: Samples):
    found = memory.assign_to_prototypes(s.vector, memory.first_per_class(s.vector))
    return found.withColumn("similarity", F.round("similarity", 6))


@check("w05_last_per_class", oracle("vector", "select label, vec_id, cast(age as int) as age from (select *, row_number() over (partition by label order by vec_id desc) as age from vector) r where age <= 4"))
def last_per_class(s: Samples):
    return memory.last_per_class(s.vector, 4).select("label", "vec_id", "age")


@check("t01_stream_memory", oracle("vector", "select label, arrival from (select label, vec_id as arrival, row_number() over (partition by label order by vec_id desc) as age from vector) r where age <= 6"))
def stream_memory(s: Samples):
    from scriptoria.session import ensure_checkpoint_dir
    from scriptoria.streaming import memory as stream
    from uuid import uuid4

    progress = f"{ensure_checkpoint_dir(s.spark)}/memory-{uuid4().hex}"
    source = s.spark.readStream.schema(s.raw("embeddings").schema).parquet(f"{s.folder}/embeddings.parquet*")
    vectors = source.select("label", F.col("vec_id").alias("arrival"), "embedding")
    stream.keep_last_per_class(vectors, 6, progress).awaitTermination()
    return stream.read_memory(s.spark, progress).select("label", "arrival")
