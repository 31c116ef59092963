"""Nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards by a hash.  Each shard gets a graph: vectors are
inserted in batches that double, a greedy search from the entries proposes neighbours, and
relaxed distance pruning keeps a candidate only if no kept one is ``1 / alpha`` times nearer
to it than the inserted vector is; reverse edges are pruned the same way, and a second pass
inserts every vector again.  Entries are the vector in the middle, vectors each of which is the
farthest from all before it, so that every cluster has one, and whatever no entry reaches; a
search begins at those nearest to the query.  A query is searched in every shard by a beam, what it meets is
measured again in double precision on the original vectors, and the best over all shards
are merged.

Equal vectors are one node that carries their least ids, as many as a result can hold, so a
vector that a third of the rows share is a node like any other.  Shards hold ``shard_size``
vectors on average; every shard reads the blocks of queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, and
rows without id, take no part; repeated rows count once; vectors meet those of their own
length only; fewer candidates than asked for are all returned; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import checkpointed

#: Rows of a numpy step: bounds of memory only.
STEP = 512
#: One entry for so many nodes, and the number of entries that a search begins at.
NODES_PER_ENTRY, STARTS = 16, 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """One shard: scaled vectors, neighbours (-1: none) and entries."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None, entries: np.ndarray | None = None, degree: int = 32):
        self.x = (vectors / np.abs(vectors).max()).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.entries = self.spread() if entries is None else entries
        self.out = np.full((len(vectors), degree), -1, np.int32) if neighbours is None else neighbours

    def spread(self) -> np.ndarray:
        """The node in the middle, then nodes that are farthest from all before them."""
        least = ((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1)
        found = [int(np.argmin(least))]
        least = np.full(len(self.x), np.inf, np.float32)
        while len(found) <= len(self.x) // NODES_PER_ENTRY:
            last = found[-1]
            least = np.minimum(least, self.norm + self.norm[last] - 2 * (self.x @ self.x[last]))
            least[last] = -np.inf
            found.append(int(np.argmax(least)))
        return np.array(found, np.int32)

    def reach(self) -> None:
        """Make a node that no entry reaches an entry, until all are reached."""
        reached = np.zeros(len(self.x), bool)
        front, more = self.entries, []
        while True:
            while len(front):
                reached[front] = True
                near = np.unique(self.out[front])
                front = near[(near >= 0) & ~reached[near]]
            if reached.all():
                break
            more.append(int(np.argmin(reached)))
            front = np.array(more[-1:])
        self.entries = np.append(self.entries, np.array(more, np.int32))

    def beam(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes met by every query (-1 pads) and their squared distances, ascending."""
        b, n = len(queries), len(self.x)
        width = min(width, n)
        rows = np.arange(b)
        ids = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        fresh = np.zeros((b, width), bool)
        seen = np.zeros((b, n), bool)
        q2 = np.einsum("ij,ij->i", queries, queries)
        d = q2[:, None] + self.norm[self.entries] - 2 * queries @ self.x[self.entries].T
        order = np.argsort(d, axis=1, kind="stable")[:, :min(STARTS, width)]
        some = order.shape[1]
        ids[:, :some], dist[:, :some], fresh[:, :some] = self.entries[order], np.take_along_axis(d, order, axis=1), True
        seen[rows[:, None], ids[:, :some]] = True
        while len(rows):
            first = fresh[rows].argmax(axis=1)
            live = fresh[rows, first]
            rows, first = rows[live], first[live]
            if not len(rows):
                break
            fresh[rows, first] = False
            near = self.out[ids[rows, first]]
            new = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], np.where(near >= 0, near, ids[rows, first][:, None])] = True
            d = q2[rows, None] + self.norm[near] - 2 * np.einsum("brd,bd->br", self.x[near], queries[rows])
            d[~new] = np.inf
            all_d = np.concatenate([dist[rows], d], axis=1)
            all_i = np.concatenate([ids[rows], np.where(new, near, -1)], axis=1)
            all_f = np.concatenate([fresh[rows], new], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[rows], ids[rows], fresh[rows] = (np.take_along_axis(a, order, axis=1) for a in (all_d, all_i, all_f))
        return ids, dist

    def prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Diverse near candidates of every point, nearest first."""
        degree = self.out.shape[1]
        result = np.full((len(points), degree), -1, np.int32)
        for a in range(0, len(points), STEP):
            p, c = points[a:a + STEP], candidates[a:a + STEP]
            order = np.sort(c, axis=1)
            c = np.where(np.diff(order, axis=1, prepend=-1) == 0, -1, order)
            c = np.where(c == p[:, None], -1, c)
            x = self.x[c]
            d = self.norm[p, None] + self.norm[c] - 2 * np.einsum("bcd,bd->bc", x, self.x[p])
            d[c < 0] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
            x = np.take_along_axis(x, order[:, :, None], axis=1)
            alive, rows = c >= 0, np.arange(len(p))
            for slot in range(degree):
                pick = alive.argmax(axis=1)
                some = alive[rows, pick]
                if not some.any():
                    break
                chosen = c[rows, pick]
                result[a:a + STEP, slot] = np.where(some, chosen, -1)
                between = self.norm[chosen, None] + self.norm[c] - 2 * np.einsum("bcd,bd->bc", x, self.x[chosen])
                alive &= ~(some[:, None] & (alpha * alpha * between <= d))
                alive[rows, pick] = False
        return result

    def insert(self, points: np.ndarray, width: int, alpha: float) -> None:
        met = np.concatenate([self.beam(self.x[points[a:a + STEP]], width)[0] for a in range(0, len(points), STEP)])
        self.out[points] = self.prune(points, np.concatenate([met, self.out[points]], axis=1), alpha)
        source = np.repeat(points, self.out.shape[1])
        target = self.out[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, starts, counts = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), int(counts.max(initial=0))), -1, np.int32)
        back[np.repeat(np.arange(len(ends)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
        self.out[ends] = self.prune(ends, np.concatenate([self.out[ends], back], axis=1), alpha)

    def build(self, width: int, alpha: float, seed: int = 0) -> Graph:
        order = np.random.default_rng(seed).permutation(len(self.x))
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]]).astype(np.int32)
        done = 1
        while done < len(order):
            step = min(done, max(STEP, len(order) // 8), len(order) - done)
            self.insert(order[done:done + step], width, alpha)
            done += step
        for a in range(0, len(order), max(STEP, len(order) // 8)):
            self.insert(order[a:a + max(STEP, len(order) // 8)], width, alpha)
        self.reach()
        return self


GRAPH = "dim int, shard int, n int, entries binary, vectors binary, neighbours binary, ends binary, ids binary"


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """vector and its *most* least ids: a hot vector costs every task *most* rows."""
    least = Window.partitionBy("vector").orderBy("id")
    few = rows.distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= most)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def graphs(rows: DataFrame, most: int, shard_size: int, degree: int, width: int, alpha: float) -> tuple[DataFrame, int]:
    """One row a shard with its graph, and the number of shards; *rows* has id and vector."""
    nodes = checkpointed(distinct_vectors(rows, most))
    shards = max(1, -(-nodes.count() // shard_size))
    dealt = nodes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), "vector", "ids")

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, lists = table["dim"][0].as_py(), table["ids"].combine_chunks()
        x = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        graph = Graph(x, degree=degree).build(width, alpha)
        sizes = np.cumsum(lists.value_lengths().to_numpy()).astype(np.int64)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()),
            "entries": pa.array([graph.entries.tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()),
            "neighbours": pa.array([graph.out.tobytes()], pa.binary()), "ends": pa.array([sizes.tobytes()], pa.binary()),
            "ids": pa.array([lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())})

    # a task a shard, whatever the shards' bytes: building costs far more than moving
    return dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, GRAPH), shards


FOUND = "query long, id long, score double"


def search(width: int, k: int):
    """The nearest of shards to blocks of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                name, who, score = one(*(row[c] for c in ("dim", "entries", "vectors", "neighbours", "ends", "ids", "q")))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (name, who, score)], names=["query", "id", "score"])

    def one(dim, entries, vectors, neighbours, ends, ids, asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, dim.as_py())
        out_edges = np.frombuffer(neighbours.as_buffer(), np.int32).reshape(len(x), -1)
        end, members = np.frombuffer(ends.as_buffer(), np.int64), np.frombuffer(ids.as_buffer(), np.int64)
        names = asked.values.field("query").to_numpy(zero_copy_only=False)
        q = asked.values.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim.as_py())
        scale = np.abs(x).max()
        graph = Graph(x, out_edges, np.frombuffer(entries.as_buffer(), np.int32))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q), STEP):
            near, _ = graph.beam((q[a:a + STEP] / scale).astype(np.float32), width)
            for name, vector, nodes in zip(names[a:a + STEP], q[a:a + STEP], near, strict=True):
                nodes = nodes[nodes >= 0]
                exact = np.sqrt(((x[nodes] - vector) ** 2).sum(axis=1))
                sizes = end[nodes] - np.where(nodes > 0, end[nodes - 1], 0)
                at = np.repeat(end[nodes] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
                score, who = np.repeat(exact, sizes), members[at]
                score, who = score[who != name], who[who != name]
                best = np.lexsort((who, score))[:k]
                found.append((np.full(len(best), name), who[best], score[best]))
        return tuple(np.concatenate(v) for v in zip(*found))

    return run


#: Tasks of a search at most, unless there are more shards.
TASKS = 10_000


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10, shard_size: int = 4096, degree: int = 32, build_width: int = 64,
            search_width: int = 128, alpha: float = 1.2, block: int = 2048) -> DataFrame:
    """query, rank, id, score: the *k* nearest of *candidates* (id, vector) to each of *queries* (id, vector).

    A query is not a candidate of its own: ids that equal the query's are left out.
    """
    good = candidates.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("id"), "vector")
    asked = queries.where(F.col("id").isNotNull() & usable(F.col("vector"))).select(F.col("id").cast("long").alias("query"), "vector").distinct()
    built, shards = graphs(good, k + 1, shard_size, degree, build_width, alpha)
    built = checkpointed(built)
    asked = checkpointed(asked)
    blocks = max(1, -(-asked.count() // block))
    # a block holds about as many queries as asked for, hashed by id, and is met by every shard of its length
    packed = asked.groupBy(F.size("vector").alias("dim"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("query", "vector")).alias("q")).repartition(max(1, min(blocks, TASKS // shards))).withColumnRenamed("dim", "q_dim")
    # Shards and blocks are read where they are stored, by each task those it compares: nothing goes through the
    # driver, and no graph or query is shuffled once for each block or shard.
    met = built.join(packed.hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim"))
    found = met.select("dim", "entries", "vectors", "neighbours", "ends", "ids", "q").mapInArrow(search(search_width, k), FOUND)
    order = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

