"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

#: Up to so many links (16 MB) any task could hold a hub's, so that a round needs no tables between its steps.
FEW = 1 << 20


def _stars(edges: DataFrame) -> tuple[int, bool]:
    """(links, whether all hang on the smallest node of their component): links (u > v) where no node has two below it, or one on either side."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    links, odd = nodes.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()
    return links or 0, not odd


def _few_round(edges: DataFrame) -> DataFrame:
    """Both steps on few links, each by one window."""
    near = Window.partitionBy("u")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.withColumn("m", F.least(F.min("v").over(near), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    low = F.min("v").over(near)
    moved = large.select("u", "v", low.alias("m")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
    return moved.where("u <> v").distinct()


def _joined(edges: DataFrame, low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with the smallest node m of each u. m is written first, so that the join stands between plain shuffles, which
    adaptive execution can split: a hub's links are no single task's work."""
    low = cut(low)
    return edges.join(low, "u"), low


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved, low = _joined(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved, low = _joined(down, down.groupBy("u").agg(F.min("v").alias("m")))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), low


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of long node numbers -> (node, component), component being the smallest node.

    Only linked nodes are returned. Each round is written to the shared folder, and the round before is deleted; the driver sees two
    numbers a round, and rounds end when stars are left. A round on few links is one job. An empty table gives no rows; null ends, loops and repeated links do no harm.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        links, done = _stars(now)
        if done:
            break
        before = now
        if links <= FEW:
            now = cut(_few_round(before))
            discard(before)
            continue
        large, low = _large_star(before)
        large = cut(large)
        small, lower = _small_star(large)
        now = cut(small)
        discard(before, large, low, lower)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
