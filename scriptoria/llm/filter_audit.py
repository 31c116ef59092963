"""Interaction of filters: what each filter removes, in every order in which they can be applied.

1. Every row gets the mask of the filters it fails; a filter is a boolean column, and copies
   of a text with a smaller id are a filter of their own.
2. Rows are counted by part, mask and flags (up to 2**n masks a part).
3. Each part's counts become a count-weighted decision diagram.  Swaps of adjacent levels
   lead through all n! orders; in each the all-pass path from the root gives, step by step,
   what the filter there removes and what stays.

Copies are found without bringing them together: the least id of each text is one partly
aggregated row a text and task, and meets the rows again by text and id.  Texts are told
apart by SHA-256.

Defined results: a null text is the empty text, a null part the empty string; a filter whose
condition is null is passed; a null id is no copy and nobody's smaller id, and has no flags;
rows equal in id and text are not copies of each other; several flag rows of one id count as
flagged if one is; an empty table gives no rows; columns of other names are not looked at.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import SPACE, stored, whole_text
from scriptoria.llm.decision_diagram import Diagram, orders_by_swaps

#: All orders are listed, n! a part.
MOST_FILTERS = 8
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, lost array<long>, shapley long"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def text_filters(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, marks: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions of short, repetitive, shouting and marked-up texts."""
    some = words(text)
    return {
        "A": F.size(some) < least_words,
        "B": 100 * F.size(F.array_distinct(some)) < distinct_percent * F.size(some),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > capital_percent * F.length(text),
        "D": F.length(F.translate(text, marks, "")) < F.length(text),
    }


def masks(docs: DataFrame, filters: dict[str, Column], copies: str, flags: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask, n and one count for each column of *flags* (its first column is the id, the others are booleans).

    Bit i of the mask is filter i in the order of the names of *filters* and *copies*.
    """
    names = sorted([*filters, copies])
    bits = {f: F.when(c, 1 << names.index(f)).otherwise(0) for f, c in filters.items()}
    rows = stored(docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(whole_text(text), 256)).alias("sha"),
        reduce(lambda a, b: a + b, bits.values(), F.lit(0)).alias("mask")))
    key, *kinds = flags.columns
    first = rows.groupBy("sha").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    flagged = flags.groupBy(F.col(key).alias("id")).agg(*(F.max(F.coalesce(F.col(k), F.lit(False))).alias(k) for k in kinds))
    told = rows.join(first, ["id", "sha"], "left").join(flagged, "id", "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << names.index(copies)).otherwise(0)
    counts = told.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(
        F.count("*").alias("n"), *(F.count(F.when(F.col(k), 1)).alias(k) for k in kinds))
    return counts.select("part", "mask", "n", F.array(*kinds).alias("flagged"))


def steps_of(names: list[str], part: str, held: dict[int, tuple[int, ...]]) -> list[tuple]:
    """All rows of a part, from the counts of its masks."""
    n = len(names)
    failing = [sum(c[0] for m, c in held.items() if m >> f & 1) for f in range(n)]
    alone = [held.get(1 << f, (0,))[0] for f in range(n)]
    diagram, seen, shapley = Diagram(n, held), [], [0] * n
    swaps = orders_by_swaps(n)
    while True:
        path = list(diagram.all_pass())
        name = "".join(names[f] for f in diagram.order)
        for step, (f, removed, kept) in enumerate(path, 1):
            seen.append((name, step, f, removed, kept))
            shapley[f] += removed[0]
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    return [(part, name, step, kept[0], removed[0], failing[f] - removed[0], alone[f], list(removed[1:]), shapley[f]) for name, step, f, removed, kept in seen]


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """STEPS of every part, order and step, from (part, mask, n, flagged)."""
    names = sorted(names)
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{factorial(len(names))} orders are too many to list")

    def steps(table: pa.Table) -> pa.Table:
        held = {r["mask"]: (r["n"], *r["flagged"]) for r in table.to_pylist()}
        rows = steps_of(names, table["part"][0].as_py(), held)
        kinds = (pa.string(), pa.string(), pa.int32(), *(pa.int64(),) * 4, pa.list_(pa.int64()), pa.int64())
        fields = [s.split()[0] for s in STEPS.split(", ")]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(fields, zip(*rows, strict=True), kinds, strict=True)})

    return counts.groupBy("part").applyInArrow(steps, STEPS)
