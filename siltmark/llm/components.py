"""Connected components of a graph of any size by alternating large-star and small-star contraction."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from . import _shared as S


def components(edges: DataFrame, root: str) -> DataFrame:
    """edges (a long, b long) to (node, root): the smallest node reachable, for every node that an edge names.

    Each round joins every node with its smallest neighbour, so a hub's links are a skewed join and not one task's
    window; rounds grow with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = S.materialised(e, f"{root}/cc0")
    state = None
    for k in count(1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: each larger neighbour to the smallest of all
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each smaller neighbour, and the node itself, to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = S.materialised(small, f"{root}/cc{k}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        S.remove(f"{root}/cc{k - 1}")
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
