"""Count windows, running aggregates and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import slice_end


def count_windows(words: DataFrame, key: str, size: int = 10, slide: int = 5, flush: bool = False) -> DataFrame:
    """(key, fire, n): the count windows of each key. Without flush a window fires after every slide occurrences, with
    min(fire * slide, size) of them. With flush windows fire at size, then every slide, and once more for what is left
    at the end of the input: ceil(n / slide) in all. Only counts are shuffled; occurrences are not kept."""
    n = F.col("n_all")
    fires = F.ceil(n / slide) if flush else F.floor(n / slide)
    counts = words.groupBy(key).agg(F.count("*").alias("n_all")).withColumn("fires", fires.cast("int")).where("fires > 0")
    rows = counts.withColumn("fire", F.explode(F.sequence(F.lit(1), F.col("fires"))))
    value = F.least(F.lit(size), n - (F.col("fire") - 1) * slide if flush else F.col("fire") * slide)
    return rows.select(key, F.col("fire").cast("long").alias("fire"), value.cast("long").alias("n"))


def running_sum(df: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The sum of value over a key's rows so far."""
    return F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def last_mean(key: str, order: list[str], value: str, rows: int = 10) -> Column:
    return F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - rows, 0))


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def retracted(events: DataFrame, key: str, size: int, slide: int) -> DataFrame:
    """(key, at, n): how many events (key, t) each window [at - size, at) holds, for ends at multiples of slide. A slice adds
    its count at its end and takes it back when the window has passed it; the running sum is the window's count, which
    stands until the next change. Only counts per slice are shuffled."""
    slices = events.groupBy(key, slice_end(F.col("t"), slide).cast("long").alias("at")).agg(F.count("*").alias("diff"))
    changes = slices.union(slices.select(key, F.col("at") + size, -F.col("diff"))).groupBy(key, "at").agg(F.sum("diff").alias("diff"))
    w = Window.partitionBy(key).orderBy("at")
    held = changes.select(key, "at", F.sum("diff").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("at").over(w).alias("until")).where("n > 0")
    return held.select(key, F.explode(F.sequence("at", F.col("until") - slide, F.lit(slide).cast("long"))).alias("at"), "n")
