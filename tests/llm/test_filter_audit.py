"""Filter audit against applying every order of filters to every row."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptoria.llm import filter_audit
from scriptoria.llm.common import whole_text
from scriptoria.llm.decision_diagram import Diagram, orders_by_swaps

SCHEMA = "doc_id long, text string, lang string, id string, sha string, mask string"


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_lead_through_all_orders(n):
    order = list(range(n))
    seen = {tuple(order)}
    for level in orders_by_swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=16))
def test_diagram_of_any_counts(held):
    held = held or {0: (0, 0)}
    diagram = Diagram(4, held)
    for level in [None, *orders_by_swaps(4)]:
        if level is not None:
            diagram.swap(level)
        before = 0
        for f, removed, kept in diagram.all_pass():
            assert removed == tuple(sum(c[k] for m, c in held.items() if m >> f & 1 and not m & before) for k in (0, 1))
            before |= 1 << f
            assert kept == tuple(sum(c[k] for m, c in held.items() if not m & before) for k in (0, 1))


def test_equal_counts_share_nodes():
    assert Diagram(5, {m: (7,) for m in range(32)}).size() == 5


def brute(rows, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    split = str.maketrans("\t\n\x0b\x0c\r", "     ")
    fails = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = [w for w in t.translate(split).split(" ") if w]
        mask = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                "D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and least[t] < doc_id}
        fails.append((lang or "", mask, doc_id in good, doc_id in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if f[1][letter]]
                left = [f for f in left if not f[1][letter]]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[1][letter] for f in mine) - len(gone), sum(f[1][letter] and sum(f[1].values()) == 1 for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    filters = filter_audit.text_filters(whole_text())
    flags = table.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    out = filter_audit.audit(filter_audit.masks(docs, filters, "E", flags), [*filters, "E"]).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"], *r["lost"], r["shapley"]] for r in out}
    assert len(got) == len(out)
    return got


def test_random_rows(spark):
    draw = random.Random(5)
    texts = ["", "a b", "A B\tC", "x" * 50_000, "word " * 250, " ".join(map(str, range(210))), " ".join(map(str, range(210))) + " #", "é$ü" * 3, "Q" + "q" * 32, "Q" + "q" * 33]
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, *texts]), draw.choice([None, "", "en", "de"])) for _ in range(150)]
    rows += [(100 + i, "hot copy", "en") for i in range(100)] + [(5, "hot copy", None), (5, "hot copy", None)]
    labels = [(i, draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for i in [*range(0, 120, 2), 4, 4, None]]
    assert run(spark, rows, labels) == brute(rows, labels)


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, None, None)], [(1, "a", "b"), (1, "a", "b")], [(1, " ".join(["long", "Words#"] * 400_000), "en")]])
def test_small_tables(spark, rows):
    assert run(spark, rows, []) == brute(rows, [])


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, flagged array<long>"), [str(i) for i in range(9)])
