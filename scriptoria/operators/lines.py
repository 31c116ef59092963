"""Operators on the text lines of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import geometry as G
from scriptoria.operators.scan import GROUP_LIMIT, any_group_exceeds, prefix_scan, row_numbers
from scriptoria.session import checkpointed


def reading_order(lines: DataFrame, key: str = "page_id", idx: str = "line_idx", name: str = "place") -> DataFrame:
    """Number the lines of a page from 1 by the mean y of their vertices, then by index."""
    keyed = lines.withColumn("_mean_y", G.mean_y(F.col("points")))
    return row_numbers(keyed, [key], [F.col("_mean_y"), F.col(idx)], name).drop("_mean_y")


def box_centre() -> tuple[Column, Column]:
    """Centre of a box, cut down to whole pixels."""
    return F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2)


def polygon_centre(points: str = "points") -> tuple[Column, Column]:
    return G.mean_x(F.col(points)), G.mean_y(F.col(points))


def inside_region(rows: DataFrame, region: DataFrame, centre: tuple[Column, Column], key: str = "page_id") -> DataFrame:
    """Rows whose centre lies in the page's region; pages without region keep all."""
    placed = rows.withColumn("_cx", centre[0]).withColumn("_cy", centre[1])
    joined = placed.join(region.select(key, F.col("points").alias("_region")), key, "left")
    inside = G.contains_point(F.col("_region"), F.col("_cx"), F.col("_cy"))
    return joined.filter(F.coalesce(inside, F.lit(True))).drop("_cx", "_cy", "_region")


def lookup_scores(rows: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Attach scores by key, 0.0 where there is none."""
    return rows.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lines_per_page(pages: DataFrame, lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Number of lines of every page, 0 included."""
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"))
    return pages.select(key).join(counts, key, "left").fillna(0, ["n_lines"])


# Rows of a stretch that one array holds, and what keeps the share of a height defined.
FOLD_ROWS = 20_000
EPS = 1e-6


def suppress_rows(boxes: DataFrame, threshold: float = 0.95, group_limit: int = GROUP_LIMIT, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Drop boxes whose vertical extent a kept box of the page covers; x is ignored.

    Boxes are taken by (y1, pred_idx).  A box more than *threshold* of whose height
    overlaps a kept one goes into the first such place, replacing it if taller.

    A box can only meet kept boxes that reach below ``y1 + threshold * height``.  So
    the page falls into stretches: one ends where nothing before reaches far enough
    down to meet anything after.  Stretches are independent and are folded side by side.
    """
    order = [F.col("y1"), F.col("pred_idx")]
    need = F.col("y1") + threshold * (F.col("y2") - F.col("y1") + 1e-6)
    rows = boxes.select("page_id", "pred_idx", "y1", "y2", need.alias("_need"))
    sliced = any_group_exceeds(boxes, ["page_id"], group_limit)
    reach = prefix_scan(rows, ["page_id"], order, {"_reach": ("max", F.col("y2"))}, inclusive=False, sliced=sliced)
    back = [F.col("y1").desc(), F.col("pred_idx").desc()]
    both = prefix_scan(reach, ["page_id"], back, {"_later_need": ("min", F.col("_need"))}, sliced=sliced)
    # A stretch starts at a box if no box before reaches what any box from here on needs.
    starts = F.when(F.col("_reach").isNull() | (F.col("_reach") <= F.col("_later_need")), 1).otherwise(0)
    placed = prefix_scan(
        both, ["page_id"], order, {"_stretch": ("sum", starts), "_n": ("count", F.lit(1))}, sliced=sliced
    )
    survivors = fold_stretches(placed, threshold, fold_rows).select("page_id", "pred_idx")
    return boxes.join(survivors, ["page_id", "pred_idx"], "left_semi")


def fold_stretches(placed: DataFrame, threshold: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Boxes kept of every stretch: page_id, pred_idx from page_id, _stretch, _n, pred_idx, y1, y2.

    The rows of a stretch are taken in parts of *fold_rows*; a part is one array, folded
    onto what the parts before it kept.  Almost always one part is all there is.  What is
    kept of a stretch barely overlaps, so it stays small however long the stretch is, and
    there are as many steps as the longest stretch has parts.
    """
    parts = placed.groupBy("page_id", "_stretch").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_size"))
    dealt = placed.select("page_id", "_stretch", "_n", "pred_idx", "y1", "y2").join(parts, ["page_id", "_stretch"])
    dealt = dealt.withColumn("_part", F.floor((F.col("_n") - F.col("_first")) / fold_rows).cast("int"))
    box = F.struct("_n", "pred_idx", "y1", "y2")
    packed = dealt.groupBy("page_id", "_stretch", "_part").agg(F.array_sort(F.collect_list(box)).alias("rows"), F.first("_size").alias("_size"))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    kept_type = f"array<struct<pred_idx:{kinds['pred_idx']},y1:{kinds['y1']},y2:{kinds['y2']}>>"

    def place(kept: Column, row: Column) -> Column:
        own = F.struct(row["pred_idx"].alias("pred_idx"), row["y1"].alias("y1"), row["y2"].alias("y2"))
        height = row["y2"] - row["y1"]

        def covered(k: Column) -> Column:
            shared = F.least(k["y2"], row["y2"]) - F.greatest(k["y1"], row["y1"])
            return shared > threshold * (height + EPS)

        at = F.array_position(F.transform(kept, covered), F.lit(True))
        taller = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (height > k["y2"] - k["y1"]), own).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(own))).otherwise(taller)

    def fold(rows: DataFrame, before: Column) -> DataFrame:
        return rows.select("page_id", "_stretch", "_size", "_part", F.aggregate("rows", before, place).alias("kept"))

    none = F.array().cast(kept_type)
    packed = checkpointed(packed)  # read for the longest stretch and for the fold
    longest = packed.agg(F.max("_size")).first()[0] or 0
    if longest <= fold_rows:
        done = fold(packed, none)
    else:
        held = fold(packed.filter("_part = 0"), none)
        for part in range(1, -(-longest // fold_rows)):
            held = checkpointed(held)
            more = packed.filter(F.col("_part") == part).select("page_id", "_stretch", "rows")
            joined = held.join(more, ["page_id", "_stretch"], "left")
            held = joined.select("page_id", "_stretch", "_size", "_part", F.aggregate(F.coalesce("rows", F.array().cast(dict(packed.dtypes)["rows"])), F.col("kept"), place).alias("kept"))
        done = held
    return done.select("page_id", F.explode("kept").alias("k")).select("page_id", "k.pred_idx")
