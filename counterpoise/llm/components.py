"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import stored


def linked_rows(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest row reachable from each of n rows by the links a-b, given earlier roots."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            nearer = root[root]
            if (nearer == root).all():
                break
            root = nearer


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: long): root is the smallest node of
    the component. Nodes without an edge do not appear.

    Every round each node tells its larger neighbours, then its smaller ones, of the
    smallest node it knows, until nothing changes. A round is two joins on the node, whose
    one side has a row per node; it is stored, so a lost executor repeats one round at most.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a > b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
                 .join(least, "a")
                 .select(F.col("v").alias("a"), F.least("a", "m").alias("b")))
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        large = large.union(own).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").filter("b > m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(small.union(smallest.select("a", F.col("m").alias("b")))
                       .filter("a > b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
