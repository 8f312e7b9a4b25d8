"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Staged


def forest(links: np.ndarray, first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked one of n to a root of its component; links are those of ``first`` with ``second``."""
    near = np.zeros((n, n), bool)
    near[np.ix_(first, second)] = links
    near |= near.T
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0:
            reached = np.zeros(n, bool)
            front = np.array([k])
            reached[k] = True
            while len(front):
                front = np.flatnonzero(near[front].any(0) & ~reached)
                reached[front] = True
            root[reached] = k
    own = np.flatnonzero(root != np.arange(n))
    return root[own], own


def _large_star(edges: DataFrame, stage: Staged, name: str) -> DataFrame:
    """Links each node's larger neighbours to the least of it and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, stage: Staged, name: str) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them. Takes edges with u > v."""
    least = stage.write(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, stage: Staged, name: str = "components") -> DataFrame:
    """node, component for every node with an edge (columns u, v of one integer type; loops and repeats are allowed).

    component is the smallest node reachable. Each round is a minimum per node with map-side combination and a join.
    The minima are written before the join, so that both its sides are plain exchanges, whose large keys (the centres
    of stars) adaptive execution splits; rounds grow with the logarithm of the diameter. Every round is written to the
    shared folder, so lineage stays short and nothing is collected but a count and a checksum.
    """
    now = stage.write(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        large = stage.write(_large_star(now, stage, f"{name}-{k}-a"), f"{name}-{k}-large")
        after = stage.write(_small_star(large, stage, f"{name}-{k}-b"), f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}", f"{name}-{k}-a", f"{name}-{k}-b", f"{name}-{k}-large")
        # an exact, order-free fingerprint of the edges
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, now = tuple(found), after
