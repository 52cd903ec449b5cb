"""Connected components over an edge table, without collecting edges or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, forget


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: component is the smallest node that can be reached.

    Alternates large-star and small-star rounds, which need O(log^2 n) rounds whatever the
    diameter. Each round is two pre-aggregated minima and two equi-joins; the joins sit directly
    on their exchanges so that adaptive execution can split a node with very many edges. Each
    round's edges are written to the shared folder, and those of the round before go. Nodes without an edge are not returned;
    self-edges keep their node. Null ends are ignored.
    """
    e = edges.dropna(subset=[src, dst]).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.distinct(), "cc-edges")
    loops = e.where("u = v").select("u", "v")
    e = e.where("u <> v")
    mark, old = None, None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        hop = big.join(low, "u")
        small = hop.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-round")
        if old is not None:  # this round no longer needs the edges of the one before the last
            forget(old)
        old = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
