"""Connected components of a distributed edge list by union-find: unions hook roots, finds
shortcut to stars, and what is left is contracted.

In a level every root hooks to its smallest neighbour, whether that is smaller or not. Such a
chain of hooks falls in every second step, so it ends in a pair that hook each other, whose
smaller member is the smallest of its tree and becomes its root. Finds then replace parents by
their parents' parents until all trees are stars; edges between trees go on as edges of roots.
Every tree has two members at least, so the roots halve in each level, also along a chain in
which labels only rise or fall. The levels' labels are composed backwards at the end.

Labels and edges stay in the cluster; each round is written to the shared folder and the one
before it deleted, so a lost executor costs one round at most. Only whether anything changed
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _found_parents(parents: DataFrame) -> DataFrame:
    """(node, parent, moved): parents replaced by their parents, and whether that changed them."""
    up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return parents.select("node", "parent").join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))


def hooked(edges: DataFrame) -> DataFrame:
    """(node, parent): the smaller of a node's smallest neighbour and that one's; of two that hook
    each other this makes the smaller a root. edges (a, b) without loops, in any direction."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
    up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return hook.join(up, "parent").select("node", F.least("parent", "above").alias("parent"))


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges (a long, b long) -> (node, component), for every node of an edge; component is the
    smallest node that it reaches. Repeated edges, loops and an empty table are fine; an edge
    with a null end is ignored."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    ordered = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = scratch.stage(ordered.distinct(), "edges")
    levels: list[DataFrame] = []
    while not left.isEmpty():
        found = scratch.stage(_found_parents(hooked(left)), "parents")
        while not found.where("moved").isEmpty():
            before, found = found, scratch.stage(_found_parents(_found_parents(found)), "parents")
            scratch.free(before)
        levels.append(found)
        one, two = (found.select(F.col("node").alias(c), F.col("parent").alias(f"root_{c}")) for c in ("a", "b"))
        roots = left.join(one, "a").join(two, "b").where("root_a != root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        before, left = left, scratch.stage(roots.distinct(), "edges")
        scratch.free(before)
    scratch.free(left)
    if not levels:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    labels = levels[-1].select("node", F.col("parent").alias("component"))
    for level in levels[-2::-1]:
        of_root = labels.select(F.col("node").alias("parent"), "component")
        labels = level.join(of_root, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    labels = scratch.stage(labels, "labels")
    scratch.free(*levels)
    return labels
