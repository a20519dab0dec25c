"""Bins, control messages and migration plans of keyed state. Spark places state itself, so that control rows only say
where a bin would live; results do not depend on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folded(control: DataFrame, bits: int) -> DataFrame:
    """control (sequence, kind 'map' | 'move' | 'none', map array<int>, bin, worker) -> (bin, worker): the placement
    after all of it. A map sets all bins, a move one of them; later sequences win."""
    of_map = control.where("kind = 'map'").select("sequence", F.posexplode("map").alias("bin", "worker"))
    of_move = control.where("kind = 'move'").select("sequence", "bin", "worker")
    rows = of_map.unionByName(of_move).where((F.col("bin") >= 0) & (F.col("bin") < 1 << bits))
    return rows.groupBy("bin").agg(F.max_by("worker", F.struct("sequence", "worker")).alias("worker"))


def checked(control: DataFrame, bits: int) -> None:
    """Raises where two messages share a sequence, or a map has not one worker per bin."""
    if control.groupBy("sequence").count().where("count > 1").limit(1).count():
        raise ValueError("two control messages share a sequence number")
    if control.where((F.col("kind") == "map") & (F.size("map") != 1 << bits)).limit(1).count():
        raise ValueError("a map needs a worker for every bin")


def spread(bits: int, workers: int) -> list[int]:
    """Bins over workers in turn."""
    return [b % workers for b in range(1 << bits)]


def halved(bits: int, workers: int) -> list[int]:
    """Bins in pairs: the even one on a worker of its own number, the odd one half the workers further."""
    return [(b if b % 2 == 0 else b - 1 + workers // 2) % workers for b in range(1 << bits)]


def skewed(bits: int, workers: int) -> list[int]:
    """The lower half of the bins as halved(), the upper half in turn."""
    n = 1 << bits
    return halved(bits, workers)[: n // 2] + spread(bits, workers)[n // 2 :]


def matching(edges: dict[int, list[int]]) -> dict[int, int]:
    """A largest set of pairs (sender: receiver) in which nobody is twice: each sender in turn takes a free receiver, or
    one whose sender finds another."""
    sender_of: dict[int, int] = {}

    def place(sender: int, seen: set[int]) -> bool:
        for receiver in edges[sender]:
            if receiver not in seen:
                seen.add(receiver)
                if receiver not in sender_of or place(sender_of[receiver], seen):
                    sender_of[receiver] = sender
                    return True
        return False

    for sender in edges:
        place(sender, set())
    return {s: r for r, s in sender_of.items()}


def plan(before: list[int], after: list[int], kind: str = "sudden") -> list[list[tuple[int, int]]]:
    """Moves (bin, worker) per time step: all at once, one by one (fluid), or batched: as many at a time as there can be
    with no worker sending or receiving twice."""
    moves = [(b, old, new) for b, (old, new) in enumerate(zip(before, after)) if old != new]
    if kind == "sudden":
        return [[(b, new) for b, _, new in moves]] if moves else []
    if kind == "fluid":
        return [[(b, new)] for b, _, new in moves]
    bins: dict[tuple[int, int], list[int]] = {}
    for b, old, new in moves:
        bins.setdefault((old, new), []).append(b)
    steps: list[list[tuple[int, int]]] = []
    while bins:
        edges: dict[int, list[int]] = {}
        for old, new in bins:
            edges.setdefault(old, []).append(new)
        steps.append([(bins[pair].pop(), pair[1]) for pair in matching(edges).items()])
        bins = {pair: left for pair, left in bins.items() if left}
    return steps


def plan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Control rows of a plan file: 'M time worker...' sets a map, 'D time bin worker...' moves bins."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part.alias("p")).where("p[0] IN ('M', 'D')").withColumn("ts", F.expr("CAST(p[1] AS LONG)"))
    numbers = F.transform(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), lambda x: x.cast("int"))
    whole = rows.where("p[0] = 'M'").select("ts", F.lit("map").alias("kind"), numbers.alias("map"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("int").alias("worker"))
    single = rows.where("p[0] = 'D'").select("ts", numbers.alias("n")).select("ts", F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / 2).cast("int") - 1)).alias("i"), "n").select("ts", F.lit("move").alias("kind"), F.lit(None).cast("array<int>").alias("map"), F.col("n")[F.col("i") * 2].alias("bin"), F.col("n")[F.col("i") * 2 + 1].alias("worker"))
    return whole.unionByName(single).withColumn("sequence", F.row_number().over(Window.orderBy("ts", "kind", "bin")).cast("long"))


def placed(df: DataFrame, key: Column, bits: int, map_: DataFrame) -> DataFrame:
    """df with the bin of a key's hash and the worker of the bin (a map has 2^bits rows at most, bits 20 at most)."""
    return df.withColumn("bin", F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")).join(F.broadcast(map_) if bits <= 16 else map_, "bin", "left")
