"""Connected components by alternating star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dendrolith.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) long edges to (node, component): the smallest node reachable.

    Large-star and small-star rounds: every round links neighbours to the smallest member of a neighbourhood, which
    keeps connectivity, never adds edges and ends in stars after a logarithmic number of rounds. Only a checksum of the
    edges comes to the driver. Self loops and repeated edges are allowed; an empty table gives an empty result.
    """
    def links(e: DataFrame) -> DataFrame:
        return cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    now = links(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = links(small)
        after = state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components are not at rest after {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).union(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
