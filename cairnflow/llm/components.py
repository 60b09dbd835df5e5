"""Connected components over an edge table, by alternating large and small stars.

Each round maps every node's larger neighbours, then its smaller ones, to its least neighbour. Rounds are cut to reliable
checkpoints; nothing but two counters comes to the driver. Least neighbours are found by partial aggregation, so a hub
with any number of edges costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From u, v (long): node, root (least node of its component), for every node that has an edge but is no root."""
    stars = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    seen = _state(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(below, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(below.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        now = _state(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def spanning(n: int, i, j):
    """Root index of each of n nodes under the edges (i, j) (numpy arrays): least labels, with pointer jumping."""
    import numpy as np

    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
