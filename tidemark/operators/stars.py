"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.staging import drop_stage, stage


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): root is the smallest node reachable. Nulls and self loops are left out; repeated
    edges count once; no edges give no rows. Each round is a staged table; rounds grow with the logarithm of the
    longest path, and every row a round makes belongs to one edge."""
    now = stage(spark, edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # large-star: every larger neighbour moves to the least of the neighbours and the node itself
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every smaller neighbour, and the node, move to the least smaller neighbour
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = stage(spark, moved.where("u <> v").distinct(), "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stage(spark, now)
        now = after
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
