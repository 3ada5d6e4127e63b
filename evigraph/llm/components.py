"""Connected components of an edge table as DataFrame operations.

Every round hooks each node to its smallest smaller neighbour, follows the hooks twice, and contracts the edges; what
is left becomes the next round's graph. Minima are pre-aggregated before the shuffle and the joins may be split by
AQE, so a hub with any number of neighbours is not gathered in a task. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept


def components(edges: DataFrame, kept: Kept, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): component is the smallest node of it."""
    edges = kept.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-e0")
    label = None
    for i in range(1, rounds + 1):
        hooks = edges.groupBy("a").agg(F.min("b").alias("p"))
        hooks = kept.keep(hooks, f"{name}-h{i}")
        up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = hooks.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        parent = kept.keep(parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), f"{name}-p{i}")
        # nodes seen so far follow their label; those hooked now for the first time start here
        if label is None:
            roots = edges.select(F.col("b").alias("node")).distinct().join(parent.select(F.col("a").alias("node")), "node", "left_anti")
            now = parent.select(F.col("a").alias("node"), F.col("p").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        else:
            now = label.join(parent.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        label = kept.keep(now, f"{name}-l{i}")
        left = edges.join(parent.withColumnRenamed("p", "pa"), "a", "left").join(parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b", "left")
        left = left.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x != y")
        edges = kept.keep(left.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{name}-e{i}")
        kept.drop(f"{name}-e{i - 1}", f"{name}-h{i}", f"{name}-l{i - 1}")
        if edges.isEmpty():
            return label
    raise RuntimeError("components did not close")
