"""Running aggregates, numbering and joins that survive a group holding most rows.

A plain window puts a whole group into one task.  That is the right plan for
ordinary groups and hopeless when one group holds a third of a corpus, so
:func:`prefix_scan` first looks at the group sizes (one map-side-combined count)
and, if any group exceeds ``group_limit``, range-partitions the rows by group and
order, runs the window inside each slice and adds the totals of the slices before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptoria.session import checkpointed

# Rows of one group that one task may sort; a window spills, so this is about time.
GROUP_LIMIT = 1_000_000
# Rows that one task sorts, where their number is known: small shuffled rows may be large in memory.
TASK_ROWS = 1_000_000

_LOCAL = {
    "count": F.count,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def any_group_exceeds(df: DataFrame, by: Sequence[str], limit: int) -> bool:
    """Whether some group of *by* has more than *limit* rows."""
    if not by:
        return df.count() > limit
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    return not sizes.filter(F.col("_size") > limit).isEmpty()


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Number of all rows and of those in the largest group of *by*, in one pass."""
    if not by:
        return (n := df.count()), n
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    return tuple(v or 0 for v in sizes.agg(F.sum("_size"), F.max("_size")).first())


def _combine(op: str, before: Column, local: Column) -> Column:
    if op in ("count", "sum"):
        return F.coalesce(before + local, local, before)
    if op == "max":
        return F.greatest(before, local)
    if op == "min":
        return F.least(before, local)
    return F.coalesce(local, before)


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    running: dict[str, tuple[str, Column]],
    group_limit: int = GROUP_LIMIT,
    inclusive: bool = True,
    sliced: bool | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add running aggregates over the rows of a group up to each row.

    *running* maps a new column to ``(op, value)`` with op one of count, sum, max,
    min, last (last non-null value).  *order* must order the rows of a group totally.
    The row itself counts only if *inclusive*.  *sliced* tells whether large groups
    are to be cut, where the caller has looked at the sizes already; *sizes* are those of
    :func:`group_sizes`, whose number of rows may be 0 for rows that lie as they should.
    """
    by = list(by)
    if sliced is None:
        rows, largest = sizes or group_sizes(df, by)
        sliced = largest > group_limit
        if by and not sliced and rows > TASK_ROWS:
            df = spread(df, *by, rows=rows)
    if not sliced:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        whole = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select(
            "*", *[_LOCAL[op](value).over(whole).alias(name) for name, (op, value) in running.items()]
        )
    return _sliced_scan(df, by, order, running, inclusive)


def _sliced_scan(df, by, order, running, inclusive):
    values = {f"_v_{name}": value for name, (_, value) in running.items()}
    sliced = (
        df.select("*", *[v.alias(n) for n, v in values.items()])
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    # Slice numbers depend on sampled range bounds: store them before using them twice.
    sliced = checkpointed(sliced)

    totals = []
    for name, (op, _) in running.items():
        value = F.col(f"_v_{name}")
        if op == "last":
            total = F.max_by(value, F.when(value.isNotNull(), F.col("_pos")))
        else:
            total = _LOCAL[op](value)
        totals.append(total.alias(f"_t_{name}"))
    per_slice = sliced.groupBy(*by, "_slice").agg(*totals)
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_slice")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[
            _LOCAL["sum" if op == "count" else op](F.col(f"_t_{name}")).over(earlier).alias(f"_b_{name}")
            for name, (op, _) in running.items()
        ],
    )
    inside = Window.partitionBy(*by, "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = sliced.select(
        *df.columns,
        "_slice",
        *[_LOCAL[op](F.col(f"_v_{name}")).over(inside).alias(f"_l_{name}") for name, (op, _) in running.items()],
    )
    same = [local["_slice"] == offsets["_slice"]] + [local[c].eqNullSafe(offsets[c]) for c in by]
    return local.join(offsets, reduce(lambda a, b: a & b, same), "left").select(
        *[local[c] for c in df.columns],
        *[
            _combine(op, F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name)
            for name, (op, _) in running.items()
        ],
    )


def row_numbers(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str,
    start: int = 1,
    group_limit: int = GROUP_LIMIT,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """``row_number()`` counted from *start*, as an int column, for groups of any size.

    *sizes* is what :func:`group_sizes` gives, or bounds of it, where the caller knows them.
    """
    out = prefix_scan(df, by, order, {name: ("count", F.lit(1))}, group_limit, sizes=sizes)
    kind = "int" if by else "long"
    return out.withColumn(name, (F.col(name) + (start - 1)).cast(kind))


# Up to this k Spark cuts each task's rows to k a group before the shuffle by itself.
ENGINE_LIMIT = 1000
SALTS = 64


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", engine_limit: int = ENGINE_LIMIT) -> DataFrame:
    """First *k* rows of each group; a group of any size comes down to at most k rows a part before it meets.

    Beyond *engine_limit* the group is first cut to k rows in each of SALTS parts by a hash of the row.
    """
    def first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)

    if k > engine_limit:
        df = first(df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))), [*by, "_part"]).drop("_part", rank)
    return first(df, by)


def attach_group_values(rows: DataFrame, values: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join of many rows with one row per group, spreading each group over *salts* tasks."""
    keys = list(keys)
    spread = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(spread, keys + ["_salt"]).drop("_salt")


def with_group_size(rows: DataFrame, keys: Sequence[str], name: str, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add the number of rows of each row's group; ordinary groups are counted where they lie, without a join."""
    if any_group_exceeds(rows, keys, group_limit):
        return attach_group_values(rows, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Repartition for Python work, which is bound by CPU: the partitions are not merged for being small.

    Where the number of *rows* is known, there are more partitions for more of them, so that what a task sorts does not grow.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(n, *keys)
