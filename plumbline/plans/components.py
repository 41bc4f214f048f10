"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima, each combined before its shuffle, and two
equi joins that adaptive execution can split when a hub is hot; no round
gathers the neighbours of a node into one value.  Rounds grow with the
logarithm of the longest path.  Each round's edges are written to the shared
folder, so the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import Scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", label: str = "components") -> DataFrame:
    """``(node, component)`` for every node of an edge; component: the smallest node reachable.

    Self edges and repeated edges are allowed; edges with a null end are
    ignored.  An empty frame gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, label)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = scratch.save(e, "input")
    current = scratch.save(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "round-0")
    mark, n = None, 0
    while True:
        seen = current.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["c"], seen["h"]) == mark or not seen["c"]:
            break
        mark, n = (seen["c"], seen["h"]), n + 1
        current = scratch.save(_small(_large(current)).distinct(), f"round-{n}")
        if n > 1:
            scratch.drop(f"round-{n - 2}")
    ends = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return ends.join(current.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
