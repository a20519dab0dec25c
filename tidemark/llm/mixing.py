"""Mixing sources to target token totals by entropy balancing.

Among all document rates with the wanted token total per source (and the wanted totals of further features of documents),
the one nearest to keeping every document once (least token-weighted relative entropy) is an exponential tilt:
exp(the source's multiplier + the features times theirs). Newton steps on the convex dual find the multipliers. Each step
is one aggregate over the documents (pre-aggregated by source where there are no features): it gives gradient and Hessian,
whose block of sources is diagonal, so that a source's multiplier is updated where the source is, in a table that is
joined with the documents for the next step; the driver sees the few numbers of the features alone. Sources may be many.
Rates are then rounded to copies, so that the words that a source contributes come near its target: within a class of
sizes, documents are rounded up in the order of a hash until the wanted number of words is met, and what is left over
moves on to the next smaller class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, lookup_join, stage

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size, and a document's copies at most so many.
MOST = 3
#: Parts of a size class that are rounded alike.
PARTS = 1024


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")), F.lit(0)).cast("long")


def ranked(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """sizes (source, size, one row per source) with at: the source's number in the order of code points, null last. Rows
    are sorted over all tasks; only the number of rows per task is known to the driver."""
    keyed = sizes.withColumn("tm_null", F.col("source").isNull())
    rows = keyed.repartitionByRange("tm_null", "source").sortWithinPartitions("tm_null", "source").drop("tm_null")
    rows = stage(spark, rows.withColumn("tm_id", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("tm_id", 33), F.col("tm_id").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before[r["p"]] = total
        total += r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), part) if before else F.lit(0)
    return rows.withColumn("at", (offset + within).cast("long")).drop("tm_id")


def targeted(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, size) with target: shares of the total of all sizes by weight; what a source cannot take (over most
    times its size) is shared again by weight among the others until no target is above. One aggregate a round finds
    the words per unit of weight; they only grow, so that a source once over stays over."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    rows = ranked(spark, sizes).withColumn("weight", weight)
    per, total = 0.0, rows.agg(F.sum("size")).first()[0] or 0
    while True:
        over = F.col("weight") * per > most * F.col("size")
        fixed, free = rows.agg(F.sum(F.when(over, most * F.col("size"))), F.sum(F.when(~over, F.col("weight")))).first()
        after = (total - (fixed or 0)) / free if free else per
        if after <= per:
            break
        per = after
    return rows.select("source", "size", F.when(F.col("weight") * per > most * F.col("size"), (most * F.col("size")).cast("double")).otherwise(F.col("weight") * per).alias("target"))


def balanced(spark: SparkSession, rows: DataFrame, wanted: DataFrame, totals: tuple[float, ...] = (), rounds: int = 100) -> tuple[DataFrame, list[float]]:
    """rows (key, size, features array<double>), wanted (key, target), totals wanted of size * rate * feature -> (key, lam)
    and the features' multipliers, so that rates exp(lam + features . multipliers) meet all targets.

    Keys without a positive size or target get a null lam (rate 0). Keys may not be null. Steps are cut to 2 in each
    multiplier, which keeps exponentials in bounds; not to settle is an error."""
    dim, mu = len(totals), [0.0] * len(totals)
    x = [F.col("features")[i] for i in range(dim)]
    if not dim:  # equal rows of a key are one
        rows = stage(spark, rows.groupBy("key").agg(F.sum("size").alias("size")), "cells")
    live = stage(spark, rows.groupBy("key").agg(F.sum("size").alias("s")).where("s > 0").join(wanted.where("target > 0"), "key").select("key", "target", F.lit(0.0).alias("lam")), "lam")
    scale = max(live.agg(F.sum("target")).first()[0] or 0.0, 1.0)
    for _ in range(rounds):
        tilt = F.col("lam") + sum((v * m for v, m in zip(x, mu)), F.lit(0.0))
        mass = lookup_join(rows, live, ["key"], "inner").withColumn("mass", F.col("size") * F.exp(tilt))
        cells = [(i, j) for i in range(dim) for j in range(i + 1)]
        # gradient and Hessian: d and its target for the key, b with each feature, c between features
        sums = mass.groupBy("key").agg(F.first("target").alias("target"), F.first("lam").alias("lam"), F.sum("mass").alias("d"), *[F.sum(F.col("mass") * v).alias(f"b{i}") for i, v in enumerate(x)], *[F.sum(F.col("mass") * x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells])
        sums = stage(spark, sums.withColumn("g", F.col("d") - F.col("target")), "newton")
        of = [F.max(F.abs("g")), *[F.sum(f"b{i}") for i in range(dim)], *[F.sum(F.col("g") * F.col(f"b{i}") / F.col("d")) for i in range(dim)], *[F.sum(F.col(f"c{i}_{j}") - F.col(f"b{i}") * F.col(f"b{j}") / F.col("d")) for i, j in cells]]
        worst, *rest = sums.agg(*of).first()
        if worst is None:
            break
        g = np.array(rest[:dim], float) - np.array(totals, float)
        if max(worst, np.abs(g).max() if dim else 0.0) <= 1e-9 * scale:
            break
        step = np.zeros(dim)
        if dim:
            h = np.zeros((dim, dim))
            for (i, j), v in zip(cells, rest[2 * dim :]):
                h[i, j] = h[j, i] = v
            step = np.linalg.solve(h + 1e-12 * scale * np.eye(dim), g - np.array(rest[dim : 2 * dim], float))
            step = np.clip(step, -2, 2)
        mu = [m - float(d) for m, d in zip(mu, step)]
        move = (F.col("g") - sum((F.col(f"b{i}") * float(d) for i, d in enumerate(step)), F.lit(0.0))) / F.col("d")
        live = stage(spark, sums.select("key", "target", (F.col("lam") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).alias("lam")), "lam")
    else:
        raise RuntimeError(f"multipliers have not settled after {rounds} steps")
    return wanted.select("key").join(live.select("key", "lam"), "key", "left"), mu


def _ceilings(part: pd.DataFrame) -> pd.DataFrame:
    """For one source: (class, part, size, rate) sums -> per class, the parts below which documents are rounded up.
    Classes come from the largest to the smallest, each taking over what the one before has left."""
    part = part.sort_values(["class", "part"], ascending=[False, True])
    out, owed = [], 0.0
    for c, g in part.groupby("class", sort=False):
        rate = g["rate"].iloc[0]
        low = np.floor(rate)
        owed += (rate - low) * g["size"].sum()
        up = np.concatenate([[0], np.cumsum(g["size"].to_numpy(float))]) if low < MOST else np.zeros(1)
        k = int(np.abs(up - owed).argmin())
        owed -= up[k]
        out.append((g["source"].iloc[0], c, int(g["part"].iloc[k - 1]) + 1 if k else 0, int(low)))
    return pd.DataFrame(out, columns=["source", "class", "under", "low"])


def mixed(spark: SparkSession, docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs (key, text, source, ...) -> docs' rows with size, source_size, target, rate (the tilt), copies and taken =
    copies * size; columns of docs with these names give way.

    A null source is a source of its own and comes last; null and empty texts have size 0 and 0 words taken; a source
    of size 0 has target 0. Repeated rows with one key and size get the same copies. Nothing depends on the order of
    rows or on partitions, so reruns agree. Sources are rows of tables; none are held by the driver.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    rows = docs.drop(*[c for c in docs.columns if c in added]).withColumn("size", size_of(F.col("text")))
    return copied(spark, rows, key, weights, most)


def copied(spark: SparkSession, rows: DataFrame, key: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """mixed(), for rows that have their size; they are read more than once."""
    named = lambda df: df.withColumn("tm_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    per = rows.groupBy("source").agg(F.sum("size").cast("long").alias("size"))
    wanted = stage(spark, named(targeted(spark, per, weights, most)), "targets")
    lam, _ = balanced(spark, wanted.select(F.col("tm_source").alias("key"), "size"), wanted.select(F.col("tm_source").alias("key"), "target"))
    rate = F.coalesce(F.least(F.exp("lam"), F.lit(float(most))), F.lit(0.0))
    table = stage(spark, wanted.join(lam.withColumnRenamed("key", "tm_source"), "tm_source").select("tm_source", F.col("size").alias("source_size"), "target", rate.alias("rate")), "rates")
    rows = lookup_join(named(rows), table, ["tm_source"])
    rows = rows.withColumns({"tm_class": F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"), "tm_part": F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), F.lit(PARTS)).cast("int")})
    sums = rows.where("size > 0").groupBy(F.col("tm_source").alias("source"), F.col("tm_class").alias("class"), F.col("tm_part").alias("part")).agg(F.sum("size").alias("size"), F.first("rate").alias("rate"))
    cuts = sums.groupBy("source").applyInPandas(_ceilings, "source string, class int, under int, low int")
    cuts = stage(spark, cuts.select(F.col("source").alias("tm_source"), F.col("class").alias("tm_class"), F.col("under").alias("tm_under"), F.col("low").alias("tm_low")), "cuts")
    rows = lookup_join(rows, cuts, ["tm_source", "tm_class"])
    copies = F.coalesce(F.col("tm_low") + (F.col("tm_part") < F.col("tm_under")).cast("int"), F.lit(0)).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("tm_source", "tm_class", "tm_part", "tm_under", "tm_low")


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document; texts are read once, for their sizes."""
    sizes = stage(spark, docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    return copied(spark, sizes, "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies")


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies, with the columns of docs, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tm_doc"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    rows = copied(spark, whole, "doc_id").where("copies > 0")
    return rows.select("tm_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("tm_doc.*")
