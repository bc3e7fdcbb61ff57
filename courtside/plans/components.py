"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.plans.storage import saved


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` per node that has an edge; ``component`` is the smallest node id it reaches.

    Each round replaces the edges of every node by edges to the smallest neighbour, first towards larger
    neighbours, then towards smaller ones. Both halves are a partially aggregated ``min`` and one equi-join, so a
    hub costs one row per neighbour and its join is one that adaptive execution can split. Rounds grow with the
    logarithm of a component's diameter; every round ends in the shared checkpoint folder, so lineage stays short.

    Self-loops, repeated edges and edges with a null end add nothing; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    current = saved(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = saved(small.select("e.u", "e.v").where("u <> v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
