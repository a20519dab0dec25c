"""Sinks: nothing, sorted delimited files, verification, latency digests."""

from __future__ import annotations

import os
import threading
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def drop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def sorted_file(df: DataFrame, path: str, by: str, one: bool = False) -> None:
    """Delimited rows in order; one file only for results known to be small."""
    (df.orderBy(by).coalesce(1) if one else df.orderBy(by)).write.csv(path, mode="overwrite")


def centroid_file(pairs: DataFrame, path: str) -> None:
    """cx, cy, px, py with four decimals."""
    pairs.select(*[F.format_string("%.4f", c).alias(c) for c in ("cx", "cy", "px", "py")]).write.csv(path, mode="overwrite")


def verified(right: DataFrame, got: DataFrame) -> bool:
    """Whether two bags of rows are equal."""
    return not right.exceptAll(got).limit(1).count() and not got.exceptAll(right).limit(1).count()


def ccdf(latencies: DataFrame) -> DataFrame:
    """latency_ns -> (bucket, share): the share of samples beyond each bucket of a sixteenth of a power of two."""
    exponent = F.floor(F.log2(F.greatest("latency_ns", F.lit(16)))) - 4
    width = F.pow(F.lit(2.0), exponent)
    counts = latencies.select((F.floor(F.col("latency_ns") / width) * width).cast("long").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    up = Window.orderBy("bucket")  # one row per bucket: a thousand at most
    return counts.withColumn("share", 1 - F.sum("n").over(up) / F.sum("n").over(Window.partitionBy())).select("bucket", "share")


def timeline(latencies: DataFrame, slice_ms: int = 250) -> DataFrame:
    """(ts, latency_ns) -> percentiles of each slice of time."""
    marks = [0.25, 0.5, 0.75, 0.99, 0.999]
    rows = latencies.groupBy(F.window("ts", f"{slice_ms} milliseconds").alias("w")).agg(F.percentile_approx("latency_ns", F.array(*map(F.lit, marks)), 10_000).alias("p"), F.max("latency_ns").alias("most"))
    return rows.select(F.col("w.end").alias("slice_end"), *[F.col("p")[i].alias(f"p{str(m)[2:]}") for i, m in enumerate(marks)], "most")


def log_lines(lines: DataFrame) -> DataFrame:
    """Result logs 'key<TAB>values...' -> (key, fields)."""
    part = F.split("value", "\t")
    return lines.select(part[0].alias("key"), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))).alias("fields")).where("key <> ''")


def printed(df: DataFrame, rows: int = 20) -> DataFrame:
    """Shows the first rows and goes on with all of them."""
    df.show(rows, truncate=False)
    return df


def observed(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, Observation]:
    """df with measures taken as its rows go by; they are there once an action has run."""
    seen = Observation(name)
    return df.observe(seen, *measures), seen


def throughput(spark: SparkSession, progress: list) -> DataFrame:
    """(trigger, rows, seconds, per_second, total) of the reports of a stream's triggers."""
    rows, total = [], 0
    for p in progress:
        n, ms = int(p["numInputRows"]), max(int(p["durationMs"].get("triggerExecution", 0)), 1)
        total += n
        rows.append((int(p["batchId"]), n, ms / 1000, 1000 * n / ms, total))
    return spark.createDataFrame(rows, "trigger long, rows long, seconds double, per_second double, total long")


class Resident:
    """Samples of the resident memory of a process while a with block runs: (ns, bytes) each interval."""

    def __init__(self, interval: float = 0.5, pid: int | str = "self"):
        self.interval, self.path, self.samples, self.over = interval, f"/proc/{pid}/statm", [], threading.Event()

    def _sample(self) -> None:
        while True:
            with open(self.path) as f:
                self.samples.append((time.monotonic_ns(), int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")))
            if self.over.wait(self.interval):
                return

    def __enter__(self) -> Resident:
        self.thread = threading.Thread(target=self._sample, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


def latency(arrivals: list[Column], now: Column) -> Column:
    """Nanoseconds from the last of the arrivals that a row came from to now."""
    return (now - (F.greatest(*arrivals) if len(arrivals) > 1 else arrivals[0])).cast("long")


def breakdown(log: DataFrame) -> DataFrame:
    """log_lines() of one run -> one row: median, and of migrations the duration in ns of slices with a raised latency, the
    most of each percentile in them, and the sum and most of the reported durations.

    The median is the first bucket with a share of at most 0.7. From the first slice that begins a slice's length after
    a control time (one control time a slice), slices count as long as their third value is over twice the median. A log
    has a row per slice, so that one task holds it."""
    number = lambda i: F.col("fields")[i].cast("long")
    median = log.where("key = 'latency_ccdf' AND CAST(fields[1] AS DOUBLE) <= 0.7").agg(F.min(number(0)).alias("median"))
    by_time = Window.orderBy("t")
    lines = log.where("key = 'summary_timeline'").select(number(0).alias("t"), *[number(i + 1).alias(f"p{i}") for i in range(6)])
    lines = lines.withColumns({"at": F.row_number().over(by_time), "before": F.lag("t").over(by_time)})
    step = lines.where("at = 2").select((F.col("t") - F.col("before")).alias("step"))
    control = log.where("key = 'control_time'").select(number(0).alias("c")).withColumn("k", F.row_number().over(Window.orderBy("c")))
    first = control.join(F.broadcast(step)).join(lines.where("at > 1").select("t", "at"), F.col("c") + F.col("step") <= F.col("t")).groupBy("k").agg(F.min("at").alias("first"))
    starts = first.select((F.col("k") + F.max(F.col("first") - F.col("k")).over(Window.orderBy("k"))).alias("at"), F.lit(True).alias("starts"))
    rows = lines.join(starts, "at", "left").join(F.broadcast(median)).withColumn("high", F.col("p1") > 2 * F.col("median"))
    rows = rows.withColumn("island", F.sum((~F.col("high")).cast("int")).over(by_time))
    counted = F.col("high") & F.coalesce(F.max("starts").over(Window.partitionBy("island").orderBy("t")), F.lit(False))
    # a start on a slice that is not high ends at once
    rows = rows.withColumn("starts", F.when(F.col("high"), F.col("starts"))).withColumn("counted", counted)
    moved = log.where("key = 'migration_done'").agg(F.coalesce(F.sum(number(1)), F.lit(0)).alias("reported"), F.coalesce(F.max(number(1)), F.lit(0)).alias("reported_most"))
    most = [F.coalesce(F.max(F.when(F.col("counted"), F.col(f"p{i}"))), F.lit(0)).alias(f"most_p{i}") for i in range(6)]
    return rows.agg(F.first("median").alias("median"), F.coalesce(F.sum(F.when(F.col("counted"), F.col("t") - F.col("before"))), F.lit(0)).alias("duration"), *most).join(F.broadcast(moved))
