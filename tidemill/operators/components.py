"""Connected components by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014.
No step collects a node's neighbours: every step is a minimum per node, which
is pre-aggregated before its shuffle, and an equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.staging import release, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    least = least.select("src", F.least("src", "least").alias("least"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether every node points to one other, which points to none."""
    ends = stars.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(stars.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where(F.col("out") + F.col("into") > 1).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(src, dst)`` to ``(node, component)``, the component being its smallest node.

    Loops and repeated edges are fine. Edges with a null end are ignored. Nodes
    without an edge to another node don't appear.
    """
    now = stage(_small_star(edges.select("src", "dst").where("src != dst").distinct()), "stars")
    for _ in range(max_rounds):
        if _settled(now):
            break
        before, now = now, stage(_small_star(_large_star(now)), "stars")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.unionByName(roots)
