"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Every step takes the
minimum of a node's neighbours with a partial aggregate and joins it back, so a hub with millions of
neighbours is never gathered in one task: its rows stay spread and the adaptive skew join splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on rows (a, b) with a > b.

    Large: every neighbour above a node is linked to the least of its neighbours and itself.
    Small: every neighbour below a node, and the node, is linked to the least of them.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return linked.where("a > b").distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Nodes that have an edge, with the least node of their component: (node, component).

    Edges may repeat, point either way or be loops; nulls are left out.  No edges: no rows.
    A node without edges is not in the result; its component is itself.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    start = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a > b and a is not null and b is not null").distinct()
    now = scratch.save(start, "edges")
    seen = None
    for _ in range(max_rounds):
        step = scratch.save(_star(_star(now, True), False), "edges")
        scratch.drop(now)
        now = step
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
