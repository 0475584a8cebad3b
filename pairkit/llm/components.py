"""Connected components by rounds of contraction, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairkit.session import materialize


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges of each partition as stars around the smallest node, with no more edges than nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = list(forest.parent)
        roots = [forest.find(x) for x in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b), but those that are their own component.

    In each round partitions shrink their edges to stars, each node takes its smallest neighbour's
    name, and the stars' edges between different names go on. Joins read written tables on both
    sides, so AQE can split the partition of a node that very many edges share.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    names, found = None, []
    while True:
        stars = materialize(_contracted(edges), "stars").filter("a < b")
        step = materialize(stars.groupBy("b").agg(F.min("a").alias("name")), "names")
        found.append(step)
        left = stars.join(step.withColumnRenamed("b", "node").withColumnRenamed("name", "a_name"), F.col("a") == F.col("node"),
                          "left").drop("node").join(step, "b")
        edges = materialize(left.select(F.coalesce("a_name", "a").alias("a"), F.col("name").alias("b")).filter("a <> b").distinct(),
                            "contracted")
        if edges.isEmpty():
            break
    for step in found:
        if names is None:
            names = step.select(F.col("b").alias("node"), F.col("name").alias("component"))
            continue
        # nodes named in an earlier round follow their name; those first seen now were named before or stand for themselves
        following = step.select(F.col("b").alias("component"), F.col("name").alias("next"))
        moved = names.join(following, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        new = step.select(F.col("b").alias("node"), F.col("name").alias("component")).join(names, "node", "left_anti")
        names = materialize(moved.unionByName(new), "names")
    return names
