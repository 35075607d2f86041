"""Connected components of an edge table by alternating star contraction.

Large-star links every larger neighbour to the smallest one, small-star every
smaller one; a logarithmic number of rounds leaves stars around the smallest id
of each component. Every round is two aggregations and two joins of Spark, cut
from its lineage by a written table; no node's neighbours are ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each node's smallest neighbour takes over its neighbours."""
    if large:
        links = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = links.join(lowest, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. Nulls and self links are ignored; nodes without a link are absent."""
    current = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    current = written(current.where("u is not null and v is not null and u <> v").distinct(), "links")
    for _ in range(max_rounds):
        current = written(_star(_star(current, True), False), "stars")
        # Settled: every node has one parent at most, and no parent has one.
        ends = current.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(current.select("v", F.lit(0), F.lit(1)))
        roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if roles.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
