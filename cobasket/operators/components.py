"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cobasket.staging import scope, stage, stage_counting


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, the root being the least node connected with a node; roots too.

    Large and small stars take turns (a node hands its neighbours on to the least of them), so
    the rounds grow with the logarithm of the longest path, and no node's neighbours are collected.
    """
    state = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))}
    with scope(edges.sparkSession, "components"):
        both_ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
        down = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
        down, before = stage_counting(down, "down", **state)
        while before["n"]:
            around = down.unionByName(down.select(F.col("root").alias("node"), F.col("node").alias("root")))
            least = around.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"))
            above = around.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
            low = above.groupBy("node").agg(F.min("root").alias("least"))
            small = above.join(low, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node <> root")
            down, after = stage_counting(small.unionByName(low.withColumnRenamed("least", "root")).distinct(), "down", **state)
            if after == before:
                break
            before = after
        found = both_ends.distinct().join(down, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        return stage(found, "components", outer=True)
