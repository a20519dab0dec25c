"""k-means from the first k points, with the workloads' own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(points: DataFrame, centroids: list[tuple[float, float]]) -> DataFrame:
    """points with c, the index of the nearest centroid (the first of equals): a literal array, no join."""
    near = F.array_min(F.array(*[F.struct(F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)).alias("d"), F.lit(i).alias("i")) for i, (x, y) in enumerate(centroids)]))
    return points.withColumn("c", near["i"])


def kmeans(points: DataFrame, k: int, rounds: int, tolerance: float | None = None, order: str = "id") -> list[tuple[float, float]]:
    """k centroids at most: from the first k points in an order, means of the nearest points; empty clusters go. Ends
    sooner when no centroid moves by tolerance in a coordinate."""
    centroids = [(r["x"], r["y"]) for r in points.orderBy(order).limit(k).select("x", "y").collect()]
    for _ in range(rounds if centroids else 0):
        rows = nearest(points, centroids).groupBy("c").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("c").collect()
        moved = [(r["x"], r["y"]) for r in rows]
        still = tolerance is not None and all(abs(r["x"] - centroids[r["c"]][0]) < tolerance and abs(r["y"] - centroids[r["c"]][1]) < tolerance for r in rows)
        centroids = moved
        if still:
            break
    return centroids
