"""Connected components as DataFrame joins (no Python functions, nothing collected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges (a, b), a stored table -> (node, component): the smallest node reachable, itself included.

    Each round hooks every node to its smallest neighbour, follows the pointers twice
    and contracts the graph, so hubs shrink to one row and paths at least halve.  Rounds end
    when no edge joins two different components.  Self loops and repeated edges are
    allowed; null ends are dropped; without edges the result is empty.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    cut = work.save(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    stored: list[DataFrame] = []
    while not cut.isEmpty():
        ends = cut.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = work.save(ends.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("near")).select("child", F.least("child", "near").alias("parent")), "hook")
        twice = _followed(_followed(hook))
        jumped = work.save(twice, "jump")
        labels = work.save(labels.join(jumped.withColumnRenamed("child", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        left = cut.join(jumped.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a").join(jumped.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b")
        fewer = work.save(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        for old in (cut, hook, jumped, *stored):
            work.drop(old)
        cut, stored = fewer, [labels]
    return labels


def _followed(hook: DataFrame) -> DataFrame:
    """Every pointer's pointer."""
    return hook.join(hook.select(F.col("child").alias("parent"), F.col("parent").alias("grand")), "parent").select("child", F.col("grand").alias("parent"))


def extended(components: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """The components (node, component) with further edges (a, b), a stored table, by contracting what is known already."""
    of = lambda end: components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    contracted = work.save(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), "links")
    if contracted.isEmpty():
        return components
    found = connected_components(contracted, work).withColumnsRenamed({"node": "old", "component": "new"})
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = components.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("old"))
    return work.save(every.join(found, "old", "left").select("node", F.coalesce("new", "old").alias("component")), "labels")
