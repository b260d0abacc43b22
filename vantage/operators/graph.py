"""Graphs as edge tables (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.runtime import discard, settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every id on an edge (a, b); root: the least id of its connected component.

    First every id hands its lesser neighbours on to the least of them, which keeps the components and leaves few of the
    edges that many stars over the same ids have. Then each round takes the least label among an id and its neighbours,
    and the label of that label. A round is a join and an aggregate and is written out; the loop ends when no label
    changes. Loops and repeated edges do no harm; any ordered type serves as an id.
    """
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = settle(down, "graph_edges")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    handed = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    few = least.select("a", F.col("m").alias("b")).unionByName(handed)
    both = settle(few.unionByName(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph_edges")
    discard(down)
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "graph_labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        lower = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = settle(lower.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "graph_labels")
        done = new.filter(F.col("old") != F.col("root")).isEmpty()
        discard(labels)
        labels = new.select("id", "root")
        labels._vantage_path = new._vantage_path
        if done:
            discard(both)
            return labels
    raise RuntimeError("the components did not settle")


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, hops): the least number of edges from any seed, up to `most`. Edges lead both ways."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "hop_edges")
    reached = seeds.select("id", F.lit(0).alias("hops"))
    frontier = reached
    for k in range(1, most + 1):
        frontier = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = settle(frontier.join(reached, "id", "left_anti"), "hop_frontier")
        reached = reached.unionByName(frontier.select("id", F.lit(k).alias("hops")))
        if frontier.isEmpty():
            break
    return reached.groupBy("id").agg(F.min("hops").alias("hops"))


def closure(edges: DataFrame, most: int = 20) -> DataFrame:
    """(a, b) for every b reachable from a; raises if `most` rounds of doubling don't reach the end."""
    paths = settle(edges.select("a", "b").distinct(), "closure")
    n = paths.count()
    for _ in range(most):
        longer = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        new = settle(paths.unionByName(longer).distinct(), "closure")
        m = new.count()
        discard(paths)
        paths = new
        if m == n:
            return paths
        n = m
    raise RuntimeError("the closure did not settle")
