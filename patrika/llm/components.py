"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.session import cut_lineage


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of `edges` (src, dst); component is the least node reached.

    Each round joins every node's greater neighbours to the least of its neighbourhood (large star), then its lesser
    neighbours (small star), as in Kiveris et al., "Connected Components in MapReduce and Beyond"; the rounds end when
    no edge changes. A node with very many neighbours is one group by its key, aggregated on the map side.
    """
    both = edges.where("src is not null and dst is not null and src != dst")
    now = cut_lineage(both.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        large = sides.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        lesser = large.where(F.col("u") != F.col("v")).distinct()
        low = lesser.groupBy("u").agg(F.min("v").alias("m"))
        small = lesser.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut_lineage(small.where(F.col("u") != F.col("v")).distinct())
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
