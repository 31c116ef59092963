"""Source divergence against whole-number arithmetic over dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import source_divergence
from scriptoria.llm.count_trees import Forest, shares

SCHEMA = "doc_id long, text string, lang string, source string, term string, count string, item string, n string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, held in docs.items():
        kept = [t for t, n in held.items() if n >= least]
        mine = {s: c for (la, s), c in groups.items() if la == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q, p = share(sum(mine.values(), Counter())), {s: share(c) for s, c in mine.items()}
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def run(spark, rows, **bounds):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4)
    out = source_divergence.diverge(docs, **bounds)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


def made(n, seed):
    draw = random.Random(seed)
    words = ["The", "the", "CAT", "naïve", "Ärger", "ärger", "中文", "x", "don't", "a_b", "q9z", " ", "é", "zebra", *(f"w{chr(97 + i)}" for i in range(20))]
    return [(i, draw.choice([None, "", " ".join(draw.choices(words, k=draw.randrange(30)))]) if draw.random() < 0.2 else " ".join(draw.choices(words, k=draw.randrange(30))),
             draw.choice(["en", "de", None, ""]), draw.choice(["s1", "s2", "s3", "s4", "s5", None, "", "s1"])) for i in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"block_terms": 3, "tile_sources": 2}, {"block_terms": 8, "tile_sources": 3}])
def test_random_rows(spark, bounds):
    rows = made(300, 1) + [(7, "hot hot Hot word", "en", "s1")] * 200
    assert run(spark, rows, least=20, top=7, **bounds) == brute(rows, 20, 7)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 2, [(1, "a", "en", "x")], [(1, "", "en", "x"), (2, None, "en", "y"), (3, "b", "en", None)],
                                  [(1, "é " * 900_000 + "Z" * 1_500_000, "en", "x"), (1, "é z", "en", "y")]])
def test_small_tables(spark, rows):
    for least in (1, 2):
        assert run(spark, rows, least=least, top=50) == brute(rows, least, 50)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12).flatmap(lambda w: st.lists(st.lists(st.integers(0, 3), min_size=w, max_size=w), min_size=2, max_size=6)), st.integers(0, 5))
def test_trees_price_as_sums_do(counts, more):
    held = np.array(counts)
    totals, terms = held.sum(1) + more, held.shape[1]
    a, b = np.triu_indices(len(held), 1)
    value, priced = Forest(held).prices(a, b, totals, terms, 5)
    p = [[1 + 10**9 * (c + 5) // (int(n) + 5 * terms) for c in row] for row, n in zip(counts, totals, strict=True)]
    assert value.tolist() == [sum(abs(x - y) for x, y in zip(p[i], p[j], strict=True)) for i, j in zip(a, b, strict=True)]
    assert priced <= len(a) * 2 * max(1, 2 * terms)


def test_equal_subtrees_are_one():
    held = np.zeros((50, 256), np.int64)
    held[0, 0] = 1
    forest = Forest(held)
    assert forest.nodes() == 9 + 9  # a spine to the odd leaf, and one node a level for all else
    _, priced = forest.prices(*np.triu_indices(50, 1), np.full(50, 9), 256, 5)
    assert priced < 50  # 1,225 pairs of groups of 256 terms


def test_shares_are_exact_where_products_overflow():
    n = 9 * 10**15
    got = shares(np.array([n - 17, 0, 123456789012345]), np.array([n]), 10, 5)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (n + 50) for c in (n - 17, 0, 123456789012345)]
    with pytest.raises(OverflowError):
        shares(np.array([1]), np.array([10**16]), 1, 5)
