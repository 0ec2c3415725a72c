"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import few, small, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Each round gives a node the smallest label among itself and its neighbours, then the label of that label
    (pointer jumping), so labels cross a chain of n nodes in about log n rounds.  Every round is
    a written table of one row a node, made by one shuffle; no group is gathered.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct()
    rows = edges.count()
    both = written(few(both, 4 * rows), "edges")
    labels = written(few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), rows), "labels")
    while True:
        # the loop at each node brings its own label
        near = both.join(small(labels, 2 * rows), both.b == labels.node).groupBy("a").agg(F.min("component").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        fresh = near.join(small(up, 2 * rows), "low").select(F.col("a").alias("node"), "old", F.col("lower").alias("component"))
        fresh = written(few(fresh, 2 * rows), "labels")
        labels = fresh.select("node", "component")
        if fresh.filter("component <> old").isEmpty():
            return labels
