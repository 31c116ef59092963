"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.common import forget, stored


def connected(edges: DataFrame) -> DataFrame:
    """node, component from edges (a, b); the component is one of its nodes.

    Every round points each node to the least of itself and its neighbours, by a hash that
    changes with the round, follows the pointer once more, and replaces the ends of edges by
    what they point to: a constant share of the nodes goes on average, whatever their names.
    A node with many edges costs every task one row, since minima aggregate before the shuffle.
    """
    def rank(name: str) -> Column:
        return F.struct(F.xxhash64(F.col(name), F.lit(len(rounds))).alias("h"), F.col(name).alias("node"))

    edges = stored(edges.where("a != b").select("a", "b").distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least(rank("a"), "least")["node"].alias("to"))
        near = stored(near)
        next_ = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        to = stored(near.join(next_, "to").select("node", F.col("further").alias("to")))
        rounds.append(to)
        left = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("a_")), "a")
        left = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("b_")), "b")
        before, edges = edges, stored(left.select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a != b").distinct())
        forget(before, near)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    forget(edges)
    labels, read = rounds[-1].select("node", F.col("to").alias("component")), rounds[-1]
    for to in rounds[-2::-1]:
        later = labels.select(F.col("node").alias("to"), "component")
        labels = stored(to.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")))
        forget(to, read)
        read = labels
    return labels
