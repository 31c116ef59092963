"""Graph search against brute force."""

import numpy as np
import pytest

from scriptoria.llm import vector_graph
from scriptoria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = d[:k]
    return out


def recall(got, want):
    """Found neighbours no farther than the last true one, of all true ones."""
    hit = sum(sum(s <= want[q][-1][0] * (1 + 1e-9) for s, _ in found) for q, found in got.items())
    return hit / sum(map(len, want.values()))


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query"], [])) + 1
        out[r["query"]].append((r["score"], r["id"]))
    return out


def test_query_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    df = QUERIES["op7_vector_search"](spark, FOLDER)
    got = collect(df.selectExpr("query_id as query", "rank", "vec_id as id", "score"))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for s, i in v if (q, i) in exact)


def test_many_shards(spark):
    x = np.random.default_rng(3).normal(size=(900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").withColumn("shard", vector_graph.F.lit("x"))
    got = collect(vector_graph.nearest(df, df.where("id % 50 = 0"), shard_size=100, block=5))
    assert recall(got, brute(rows, rows[::50], 10)) >= 0.9


@pytest.mark.parametrize("clusters", [40, 1000])
def test_recall_of_clusters_in_full_shards(spark, clusters):
    """8,192 vectors in tight clusters at production settings: two shards of 4,096."""
    rnd = np.random.default_rng(clusters)
    x = rnd.normal(size=(clusters, 24))[rnd.integers(clusters, size=8192)] + 0.01 * rnd.normal(size=(8192, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = collect(vector_graph.nearest(df, df.where("id % 100 = 0")))
    hit = 0
    for q in range(0, 8192, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        tenth = np.partition(np.delete(d, q), 9)[9]
        hit += sum(s <= tenth * (1 + 1e-9) for s, _ in got[q])
    assert hit / (82 * 10) >= 0.95


def test_every_node_is_reached():
    x = np.random.default_rng(5).normal(size=(700, 96))
    graph = vector_graph.Graph(x).build(64, 1.2)
    alone = vector_graph.Graph(x, graph.out, graph.entries)
    alone.reach()
    assert len(alone.entries) == len(graph.entries) == len(set(graph.entries.tolist()))


def test_hot_vector_ties_and_bad_rows(spark):
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(500, 100, -1)]
    other = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(1, 60)]
    bad = [(900, None), (1000, []), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [1.0, float("nan"), 2.0]), (1400, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    short = [(2000, [1.0, 1.0]), (2001, [1.0, 1.5])]
    rows = hot + other + short
    df = spark.createDataFrame(rows + bad + hot[:20], "id long, vector array<double>")
    got = collect(vector_graph.nearest(df, df.where("id % 100 = 0")))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [i for _, i in found] == [i for _, i in want[q]]
    assert got[2000] == [(0.5, 2001)]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert vector_graph.nearest(df, df).collect() == []


def test_prune_keeps_diverse_neighbours():
    x = np.array([[0.0, 1.0], [1.0, 1.0], [1.1, 1.0], [0.0, 3.0], [5.0, 1.0]])
    kept = vector_graph.Graph(x, degree=4).prune(np.array([0], np.int32), np.array([[1, 2, 3, 4]], np.int32), 1.2)[0]
    assert kept.tolist() == [1, 3, -1, -1]


def test_shards_and_queries_meet_without_a_broadcast(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).tolist())] + [(300 + i, v) for i, v in enumerate(rng.normal(size=(20, 3)).tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = df.where("id % 10 = 0")
    found = vector_graph.nearest(df, asked, k=5, shard_size=40, block=7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # queries times shards went through the driver before
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    got = collect(found)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
