"""Near duplicates among embeddings by an inverted multi-index.

Each half of the unit vectors has its own codebook; a vector lies in the cell (nearest centroid of the first half,
nearest of the second) of the product grid. For a query, both halves' centroids are put in the order of a lower bound
on the squared distance to anything in their Voronoi cell, and the multi-sequence traversal visits cells in the order of
the sum of the two. It ends where the sum exceeds the squared distance that the similarity allows: no linked vector can
lie beyond, so recall is complete by construction. For a target recall below 1 it ends sooner, at the sum within which
that share of the links among the codebooks' sample lies. Everything visited is verified by its cosine in double
precision.

Codebooks are fitted on a bounded sample (chosen by hash); every vector is indexed and is a query. Their size grows with the
root of the rows of the largest label, so that cells stay small. Equal vectors are one class with a multiplicity. A slab of
the grid (one first-half centroid of one label) is dealt out in blocks of index rows times blocks of queries, so that a
crowded cell spreads over tasks; each block pair gives one row per vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup_join, small_batches, stage
from tidemark.operators.stars import components

#: Vectors that codebooks are fitted on: so many, or so many a centroid.
SAMPLE, PER_CENTROID = 8192, 8
#: Centroids of each half, at least and at most.
FEWEST, MOST = 16, 4096
#: Rows of a block, of index rows and of queries.
BLOCK = 1024


def _matrix(lists: pa.Array) -> np.ndarray:
    n = len(lists)
    return np.asarray(lists.flatten()).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is too large or small."""
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) if x.size else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means from evenly spaced rows; fewer rows than k are their own centroids."""
    c = np.unique(x, axis=0)
    if len(c) <= k:
        return c
    c = c[np.linspace(0, len(c) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and for every centroid the squared distance to the plane between it and the nearest one, at
    which its cell begins at the earliest."""
    d = _squares(x, c)
    near = d.argmin(1)
    gap = np.sqrt(_squares(c, c))[near]
    low = np.maximum(d - d.min(1, keepdims=True), 0) / np.maximum(2 * gap, 1e-12)
    low[np.arange(len(x)), near] = 0
    return near, low * low


def traversal(low1: np.ndarray, low2: np.ndarray, stop: float) -> Iterator[tuple[int, int, float]]:
    """Multi-sequence traversal for one query: cells (first-half centroid, second-half centroid, bound) in ascending order
    of the sum of their bounds, until it exceeds stop. The heap holds the next cell of each row of the sorted grid that
    has been entered."""
    order1, order2 = np.argsort(low1, kind="stable"), np.argsort(low2, kind="stable")
    s1, s2 = low1[order1].tolist(), low2[order2].tolist()
    first, second = order1.tolist(), order2.tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        bound, i, j = heappop(heap)
        if bound > stop:
            return
        yield first[i], second[j], bound
        if j + 1 < len(s2):
            heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if not j and i + 1 < len(s1):
            heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


def calibrated(units: np.ndarray, labels: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> float:
    """Where the traversal stops: the squared distance of the threshold for a recall of 1; below that, the bound within
    which so great a share of the links among the sample lies (the squared distance, if it has none)."""
    whole = max(2 - 2 * threshold, 0) + 1e-9
    if recall >= 1 or not len(units):
        return whole
    half, found = units.shape[1] // 2, []
    (n1, l1), (n2, l2) = _bounds(units[:, :half], books[0]), _bounds(units[:, half:], books[1])
    for lo in range(0, len(units), 1024):
        linked = (units[lo : lo + 1024] @ units.T >= threshold) & (labels[lo : lo + 1024, None] == labels[None, :])
        q, x = np.nonzero(linked)
        q += lo
        q, x = q[q != x], x[q != x]
        found.append(l1[q, n1[x]] + l2[q, n2[x]])
    sums = np.sort(np.concatenate(found))
    return min(whole, float(sums[min(int(np.ceil(recall * len(sums))), len(sums)) - 1]) + 1e-12) if len(sums) else whole


def _comparable() -> Column:
    e = F.col("embedding")
    sound = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0)
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(sound & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def links(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, recall: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (rep, mult, k1, k2, links: other vectors linked) and edges between reps (a, b) that
    span the components of the link graph."""
    small_batches(spark, 2000)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(_comparable())
    classes = rows.groupBy(F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", "label", F.lit("2")).alias("k2")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = stage(spark, classes, "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k = int(min(MOST, max(FEWEST, largest**0.5)))
    sample = classes.select("embedding", F.col("label").cast("string").alias("label"), F.xxhash64("rep", "k1").alias("h")).orderBy("h").limit(max(SAMPLE, k * PER_CENTROID)).toArrow()
    sizes = np.asarray(sample.column("embedding").combine_chunks().value_lengths()) if len(sample) else np.zeros(0, int)
    books, stops = {}, {}
    for d in np.unique(sizes).tolist():
        part = sample.filter(pa.array(sizes == d))
        u, names = _unit(_matrix(part.column("embedding").combine_chunks())), np.array(part.column("label").to_pylist(), object)
        books[d] = (codebook(u[:, : d // 2], k), codebook(u[:, d // 2 :], k))
        stops[d] = calibrated(u, names, books[d], threshold, recall)
    otherwise = calibrated(np.zeros((0, 2)), np.zeros(0), ((), ()), threshold, recall)

    def place(batches):
        for b in batches:
            dims = np.asarray(b.column(3).value_lengths())
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                u = _unit(_matrix(part.column(3)))
                c1, c2 = books.get(d, (np.zeros((1, d // 2)), np.zeros((1, d - d // 2))))
                (n1, l1), (n2, l2) = _bounds(u[:, : d // 2], c1), _bounds(u[:, d // 2 :], c2)
                visits = []
                for q in range(len(u)):
                    slabs: dict[int, list[int]] = {}
                    for s, c, _ in traversal(l1[q], l2[q], stops.get(d, otherwise)):
                        if (s, c) >= (n1[q], n2[q]):  # a pair is found once, from the vector in the earlier cell
                            slabs.setdefault(s, []).append(c)
                    visits.append([{"slab": s, "cells": c} for s, c in slabs.items()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(u), d, np.int32)), pa.array(n1.astype(np.int32)), pa.array(n2.astype(np.int32)), pa.array(visits, pa.list_(pa.struct([("slab", pa.int32()), ("cells", pa.list_(pa.int32()))])))], ["label", "rep", "mult", "embedding", "dim", "slab", "cell", "visits"])

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.select("label", "rep", "mult", "embedding").mapInArrow(place, f"label {label}, rep long, mult long, embedding array<double>, dim int, slab int, cell int, visits array<struct<slab: int, cells: array<int>>>")
    placed = stage(spark, placed, "placed")
    key = ["label", "dim", "slab"]
    index = placed.select(*key, "rep", "mult", "embedding", "cell", F.lit(0).alias("role"), F.lit(None).cast("array<int>").alias("cells"), F.col("slab").alias("own"))
    query = placed.select("label", "dim", F.explode("visits").alias("v"), "rep", "mult", "embedding", "cell", "slab").select("label", "dim", "v.slab", "rep", "mult", "embedding", "cell", F.lit(1).alias("role"), "v.cells", F.col("slab").alias("own"))
    both = index.union(query)
    parts = both.groupBy(*key).agg(F.ceil(F.sum(1 - F.col("role")) / BLOCK).cast("int").alias("ni"), F.ceil(F.sum("role") / BLOCK).cast("int").alias("nq")).where("ni > 0 and nq > 0")
    dealt = lookup_join(both, stage(spark, parts, "parts"), key, "inner")
    mine = F.pmod(F.xxhash64("rep", F.lit("block")), F.when(F.col("role") == 0, F.col("ni")).otherwise(F.col("nq"))).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("nq")).otherwise(F.col("ni")) - 1)))
    dealt = dealt.select(*key, F.when(F.col("role") == 0, F.col("mine")).otherwise(F.col("other")).alias("ib"), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("mine")).alias("qb"), "role", "rep", "mult", "embedding", "cell", "cells", "own")

    def compare(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role"))
        rep, mult, cell, own, slab = (np.asarray(table.column(c)) for c in ("rep", "mult", "cell", "own", "slab"))
        asked = table.column("cells").combine_chunks()
        n_asked = np.asarray(asked.value_lengths().fill_null(0))
        wanted, by = np.asarray(asked.flatten()), np.repeat(np.arange(len(rep)), n_asked)
        order = np.argsort(wanted, kind="stable")
        wanted, by = wanted[order], by[order]
        u = _unit(_matrix(table.column("embedding").combine_chunks()))
        count, ids = np.zeros(len(rep), np.int64), np.arange(len(rep))
        root = ids.copy()
        pairs = []
        x_of = np.flatnonzero(role == 0)
        for c in np.unique(cell[x_of]):
            x = x_of[cell[x_of] == c]
            q = by[np.searchsorted(wanted, c, "left") : np.searchsorted(wanted, c, "right")]
            if not len(q):
                continue
            sim = u[q] @ u[x].T >= threshold
            # the earlier cell asks; in one cell, the smaller rep
            before = (own[q] < slab[x[0]]) | ((own[q] == slab[x[0]]) & (cell[q] < c))
            same = (own[q] == slab[x[0]]) & (cell[q] == c)
            sim &= before[:, None] | (same[:, None] & (rep[q][:, None] < rep[x][None, :]))
            if sim.any():
                count[q] += sim @ mult[x]
                np.add.at(count, x, mult[q] @ sim)
                i, j = np.nonzero(sim)
                pairs.append((q[i], x[j]))
        if pairs:
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            _, ids = np.unique(rep, return_inverse=True)  # a vector may be here as query and as index row
            names = np.unique(rep)
            root = np.arange(len(names))
            a, b = ids[a], ids[b]
            while True:
                was = root.copy()
                least = np.minimum(root[a], root[b])
                np.minimum.at(root, a, least)
                np.minimum.at(root, b, least)
                root = root[root]
                if (root == was).all():
                    break
            total = np.bincount(ids, count, len(names)).astype(np.int64)
            use = np.flatnonzero(total)
            return pa.table({"rep": names[use], "n": total[use], "root": names[root[use]]}, schema=out)
        return out.empty_table()

    out = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
    found = stage(spark, dealt.groupBy(*key, "ib", "qb").applyInArrow(compare, "rep long, n long, root long"), "links")
    per = found.groupBy("rep").agg(F.sum("n").alias("others"))
    classes = classes.join(per, "rep", "left").select("rep", "mult", "k1", "k2", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return classes, found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def deduplicated(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98, recall: float = 1.0) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id (smallest vec_id reachable), kept.

    Only vectors with equal labels that are not null are compared. Vectors that are null, empty, zero, or hold null or
    non-finite components, and those without a label or vec_id, link with nothing: n_links 0, a component of their own,
    kept (null without a vec_id). Vectors of different lengths do not link. Equal vectors link with each other; rows
    that repeat count as vectors of their own. Other columns are left out; an empty table gives an empty one.
    """
    classes, edges = links(spark, vectors, threshold, recall)
    classes = stage(spark, classes, "degrees")
    comp = components(spark, edges).withColumnRenamed("node", "rep")
    classes = classes.join(comp, "rep", "left").select("k1", "k2", "links", F.coalesce("root", "rep").alias("component_id"))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = rows.where(_comparable()).select("vec_id", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64("embedding", "label", F.lit("2")).alias("k2"))
    good = keyed.join(classes, ["k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    rest = rows.where(~_comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
