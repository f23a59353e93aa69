"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _unfinished(edges: DataFrame) -> int:
    """How many nodes of distinct edges hang on two others, or on one while others hang on them: none if all are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 and up + down > 1").count()


def components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): the smallest node each linked node reaches. Nodes without links are
    absent; null ends and loops are ignored; repeated links count once. The links stay distributed; only row
    counts of each round reach the driver. Repeated links are only dropped where a round ends: neither step
    makes more rows than it gets, and each further shuffle costs the driver memory for its tasks."""
    edges = links.select("u", "v").filter("u is not null and v is not null and u <> v")
    while True:
        edges = written(_small(_large(edges)), "links")
        if not _unfinished(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
