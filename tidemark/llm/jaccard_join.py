"""Exact self-join of documents by the Jaccard similarity of their sets of word shingles.

Prefix filter under one global token order, with relations between sets used to skip work:

* Sets that are equal (by 128 bits) are one node; a task puts each of its sets into the index once, however many of its
  documents have it.
* The token order puts tokens by the load of their bucket in a table of counts over all documents (frequent buckets
  last), then by hash. Any fixed order gives right results; this one keeps frequent passages out of prefixes.
* Rows of the index are packed by group, a hash of their token, and a task sorts one group of bounded size at a time.
* A token's index list is sorted by set size; lists of crowded buckets are dealt out in parts, by hash of the set. The
  first (smallest) set of a list or part is its pivot. Round 1 verifies for each set the one pivot with which it shares
  most prefix tokens, so that n near copies make n - 1 pairs and links of round 1 are a forest.
* A set that is similar to another takes over its component as its answer. Later rounds visit only lists that still hold
  two components, and in them only pairs across components: of each set first the nearest by sketch, which halves the number of
  components of a group at least, then the nearest few, and in the end all that are left. A list is cut into blocks of positions in it; two
  blocks are skipped whole if the sizes and prefix positions in them cannot reach the threshold, or if they lie in one
  component. Rows of short lists that sizes and positions leave without a partner are marked when the index is made, and
  these rounds do not read them.
* A pair is verified only if its sizes, positions, and either its number of common prefix tokens (round 1) or the
  parity sketches of its sets (later rounds) allow the threshold. Verification compares the whole sets; a task skips
  pairs whose components it has joined before, so that what it returns is a forest of components. Only texts of sets that
  have a pair are sent: a filter of constant size passes over the others where they are read.
* After each round, components are contracted: new links are a graph of components, and only that graph is solved.

Every pair that could lie over the threshold is verified, or is already inside one component, so components are exact. The
links themselves are not a result: pairs inside one component are not verified once it has formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pieces, small_batches, stage, utf8
from tidemark.llm.hashing import mix, shingle_sets
from tidemark.operators.stars import components

#: Buckets of the count table; a constant, whatever the input.
BUCKET_BITS = 20
#: Rounds across components: one list in so many is looked at (by hash of its token), and of each set so many nearest pairs
#: with other components are verified. The first rounds join most and need not be complete; rounds end when one that has
#: looked at all lists has left nothing out.
ROUNDS = ((4, 1), (4, 1), (1, 4), (1, None))
#: Bits of a set's sketch; sets of over twice as many tokens have longer ones, up to the second number.
SKETCH, WIDEST = 1024, 4096
#: Sets of one list that one task of a later round holds at a time, and rows of the blocks that it skips.
BLOCK, SKIP = 2048, 64
#: Members that one task verifies against a pivot.
MEMBERS = 512
#: Tokens of all the sets that a task holds at a time to verify others against, beyond a single set.
HELD = 1 << 22
#: Rows of a list from which on it is dealt out in parts, unless lists are that long anyhow.
PART = 4096
#: Rows of the index that a task sorts at a time, on average; that it gathers before they are dealt out; that are packed
#: together at most.
GROUP, GATHERED, PACKED = 1 << 17, 1 << 19, 1 << 10
#: Rows of a list up to which its pairs are looked at while the index is made, so many pairs at a time.
PAIRED, PAIRS = 64, 1 << 18
#: Bits of the filter on the documents whose texts are sent to be compared.
FILTER = 1 << 24
#: Sets that a task remembers having indexed; beyond that it forgets, and a copy makes one more row.
SEEN = 1_000_000


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """(batch slice, values, offsets) for each piece of each batch; the text is the column named text."""
    for batch in batches:
        raw, offs = utf8(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in pieces(offs):
            part = raw[offs[lo] : offs[hi]]
            yield batch.slice(lo, hi - lo), *shingle_sets(part, offs[lo : hi + 1] - offs[lo], width)


def _prints(values: np.ndarray, edge: np.ndarray, apart: dict[tuple[int, int], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set, of 63 and 64 bits, with its size mixed in; 0 for an empty one. The first is the set's
    name; apart has other names for sets that share theirs with another one."""
    n, out = np.diff(edge).astype(np.uint64), []
    for add, by in ((0x632BE59BD9B4E019, 0x9E3779B97F4A7C15), (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F)):
        s = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values * np.uint64(by) + np.uint64(add)), out=s[1:], dtype=np.uint64)
        h = mix((s[edge[1:]] - s[edge[:-1]]) * np.uint64(by) + n)
        h[n == 0] = 0
        out.append(h)
    name = (out[0] >> np.uint64(1)).astype(np.int64)
    name[(name == 0) & (n > 0)] = 1
    other = out[1].view(np.int64)
    if apart:
        for i, k in enumerate(zip(name.tolist(), other.tolist())):
            if k in apart:
                name[i] = apart[k]
    return name, other


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n tokens."""
    return SKETCH << np.ceil(np.log2(np.clip(n / (2 * SKETCH), 1, WIDEST // SKETCH))).astype(np.int64)


def _sketch(values: np.ndarray, edge: np.ndarray) -> list[bytes]:
    """Parity of the tokens in each bucket, as bits. Where two sketches differ, some token is in one set only, so their
    sets differ in as many tokens at least as their sketches do in bits. Longer sketches fold into shorter ones."""
    sizes, n = _bits(np.diff(edge)), len(edge) - 1
    row = np.repeat(np.arange(n), np.diff(edge))
    flips = np.bincount(row * SKETCH + (values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=n * SKETCH)
    out = [x.tobytes() for x in np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH), axis=1)]
    for i in np.flatnonzero(sizes > SKETCH):
        flips = np.bincount((values[edge[i] : edge[i + 1]] & np.uint64(sizes[i] - 1)).astype(np.int64), minlength=sizes[i])
        out[i] = np.packbits((flips & 1).astype(np.uint8)).tobytes()
    return out


def _folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches as rows of so many bits."""
    out, sizes = np.empty((len(sketches), bits // 64), np.uint64), np.fromiter(map(len, sketches), np.int64, len(sketches))
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        out[of] = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[i] for i in of), np.uint64).reshape(len(of), -1, bits // 64), axis=1)
    return out


def _apart_bits(n: np.ndarray, sketch: np.ndarray, wide: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of pairs of rows differ; the longer ones of large sets are looked at where the folded
    ones differ in at most so many bits."""
    bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1)
    both = np.minimum(n[i], n[j])
    large = np.flatnonzero((both > 2 * SKETCH) & (bits <= most))
    width = _bits(both[large])
    for w in np.unique(width).tolist():
        some = large[width == w]
        for k in range(0, len(some), 8192):
            at = some[k : k + 8192]
            rows, of = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            table = _folded(wide[rows].tolist(), w)
            bits[at] = np.bitwise_count(table[of[: len(at)]] ^ table[of[len(at) :]]).sum(1)
    return bits


def _need(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The overlap that sets of sizes n and m have at least at a similarity of num/den."""
    return -((-num * (n + m)) // (num + den))


def _prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n + (-num * n) // den + 1


def _noted(spark: SparkSession, docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """In one pass over the texts (doc_id, fp, fp2, n, sketch) of each row, and the tokens per hash bucket over all rows: a
    table of 2^BUCKET_BITS counts."""
    blocks, size = 64, (1 << BUCKET_BITS) // 64

    def note(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for part, values, edge in _sets(batches, width):
            total += np.bincount((values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
            (fp, fp2), n = _prints(values, edge), len(edge) - 1
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).cast(pa.int64()), "fp": pa.array(fp), "fp2": pa.array(fp2), "n": pa.array(np.diff(edge).astype(np.int64)), "sketch": pa.array(_sketch(values, edge), pa.binary()), "block": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        if total.any():
            none = [pa.nulls(blocks, t) for t in (*[pa.int64()] * 4, pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(blocks), pa.int32()), pa.array([total[i * size : (i + 1) * size].astype(np.int32).tobytes() for i in range(blocks)], pa.binary())], ["doc_id", "fp", "fp2", "n", "sketch", "block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1)):
                c = np.frombuffer(c.as_buffer(), np.int32)
                total[k] = total[k] + c if k in total else c.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_pydict({"block": pa.array(total, pa.int32()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    noted = stage(spark, docs.mapInArrow(note, "doc_id long, fp long, fp2 long, n long, sketch binary, block int, counts binary"), "nodes")
    parts = noted.where("block is not null").select("block", "counts").repartition(blocks, "block").mapInArrow(add, "block int, counts binary")
    table = np.zeros((blocks, size), np.int64)
    for r in parts.toLocalIterator():
        table[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return noted.where("block is null").select("doc_id", "fp", "fp2", "n", "sketch"), table.reshape(-1)


def _levels(table: np.ndarray) -> np.ndarray:
    usual = max(8.0, table.sum() / len(table))
    return np.clip(np.floor(np.log2(np.maximum(table, 1) / usual)), 0, 63).astype(np.uint8)


def _parts(table: np.ndarray) -> np.ndarray:
    """Into how many parts the lists of each bucket's tokens are dealt."""
    return np.ceil(table / max(PART, 4 * table.sum() / len(table))).clip(1, 1 << 20).astype(np.int32)


def _postings(docs: DataFrame, tables, width: int, num: int, den: int, groups: int) -> DataFrame:
    """The index row of each prefix token of each set of a task: token, fp, prev, prev2, n, pos, part, parts, where prev and
    prev2 are the set's tokens one and two before, -1 where there is none. They are dealt to groups by token and part, and
    rows (group, packed) hold many of them: the columns' bytes one after the other."""

    def run(batches):
        lv, deal, apart = tables.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []

        def dealt():
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            group = (mix(cols[0].view(np.uint64) + mix(cols[6].astype(np.uint64))) % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            cols, group = [c[order] for c in cols], group[order]
            new = np.flatnonzero(np.diff(group, prepend=-1))
            behind = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
            cuts = np.append(np.flatnonzero(behind % PACKED == 0), len(group))
            for k in range(0, len(cuts) - 1, 64):
                some = cuts[k : k + 65]
                yield pa.RecordBatch.from_pydict({"group": pa.array(group[some[:-1]]), "packed": pa.array([b"".join(c[lo:hi].tobytes() for c in cols) for lo, hi in zip(some[:-1].tolist(), some[1:].tolist())], pa.binary())})

        for _, values, edge in _sets(batches, width):
            n = np.diff(edge)
            fp, _ = _prints(values, edge, apart)
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.zeros(len(n), bool)
            for i, f in enumerate(fp.tolist()):
                if f not in seen:
                    seen.add(f)
                    fresh[i] = True
            bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            key = (lv[bucket].astype(np.uint64) << np.uint64(57)) | (values >> np.uint64(7))
            for i in np.flatnonzero(fresh):
                order = np.argsort(key[edge[i] : edge[i + 1]])
                key[edge[i] : edge[i + 1]] = key[edge[i] : edge[i + 1]][order]
                bucket[edge[i] : edge[i + 1]] = bucket[edge[i] : edge[i + 1]][order]
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(key)) - edge[row]
            use = fresh[row] & (pos < _prefix(n, num, den)[row])
            prev, prev2 = (np.where(pos < k, -1, np.roll(key, k).view(np.int64))[use] for k in (1, 2))
            row, pos = row[use], pos[use]
            parts = deal[bucket[use]]
            held.append([key[use].astype(np.int64), fp[row], prev, prev2, *(c.astype(np.int32) for c in (n[row], pos, fp[row] % parts, parts))])
            if sum(len(h[0]) for h in held) > GATHERED:
                yield from dealt()
        if held:
            yield from dealt()

    return docs.select("text").mapInArrow(run, "group int, packed binary")


def _lists(postings: DataFrame, num: int, den: int) -> DataFrame:
    """Index lists with two different sets or more, each row with the pivot of its list or part. Rows of lists in parts all
    stay, as other parts may have more. use is 0 for a row that makes no pair of its list that sizes and positions allow, 1
    if an earlier list gives all of its pairs (see _across), else 2; rows of long lists and of those in parts have 2."""
    names = ["token", "fp", "n", "pos", "pivot", "pivot_n", "prev", "prev2", "use"]

    def whole(packed):
        cols = [[] for _ in range(8)]
        for b in packed:
            k, at = len(b) // 48, 0
            for c, kind in zip(cols, (*[np.int64] * 4, *[np.int32] * 4)):
                c.append(np.frombuffer(b, kind, k, at))
                at += k * np.dtype(kind).itemsize
        cols = [np.concatenate(c) for c in cols]
        order = np.argsort(cols[0])
        t = cols[0][order]
        twice = np.append(False, t[1:] == t[:-1])
        twice[:-1] |= twice[1:]
        order = order[twice | (cols[7][order] > 1)]  # most tokens are in one set only
        t, f, prev, prev2, n, p, part, parts = (c[order] for c in cols)
        order = np.lexsort((f, n, part, t))
        t, f, prev, prev2, n, p, part, parts = (c[order] for c in (t, f, prev, prev2, n, p, part, parts))
        new = np.append(True, (t[1:] != t[:-1]) | (part[1:] != part[:-1]))[: len(t)]
        fresh = new | np.append(True, f[1:] != f[:-1])[: len(t)]  # copies of a set come from several tasks
        t, f, prev, prev2, n, p, parts, new = (c[fresh] for c in (t, f, prev, prev2, n, p, parts, new))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(t)))
        stay = np.repeat((sizes > 1) | (parts[starts] > 1), sizes)
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        short = (size <= PAIRED) & (parts == 1)
        use = np.where(short, 0, 2).astype(np.int32)
        before = np.where(short, np.arange(len(t)) - start, 0)
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(before), np.arange(0, before.sum(), PAIRS)), len(t)))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i, j = _before(before[lo:hi], start[lo:hi])
            i += lo
            ok = _fits(n[i], n[j], p[i], p[j], num, den)
            i, j = i[ok], j[ok]
            own = _first(prev, prev2, i, j)
            for x in (i, j):
                use[x] = np.maximum(use[x], 1)
            for x in (i[own], j[own]):
                use[x] = 2
        if stay.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[stay]) for c in (t, f, n, p, f[start], n[start], prev, prev2, use)], names)

    def run(batches):
        held, of = [], None
        for b in batches:
            for group, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if group != of and held:
                    yield from whole(held)
                    held = []
                of = group
                held.append(packed)
        if held:
            yield from whole(held)

    ordered = postings.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(run, "token long, fp long, n int, pos int, pivot long, pivot_n int, prev long, prev2 long, use int")


def _before(before: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row with the first so many rows of its list, which begins at start."""
    i = np.repeat(np.arange(len(before)), before)
    return i, np.repeat(start, before) + np.arange(len(i)) - np.repeat(np.cumsum(before) - before, before)


def _fits(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes n >= m with a common token at positions p and q may reach the threshold (see _across)."""
    n, m = n.astype(np.int64), m.astype(np.int64)
    need = _need(n, m, num, den)
    return (den * m >= num * n) & (p <= n - need) & (q <= m - need) & (np.minimum(n - p, m - q) + np.minimum(p, q) >= need)


def _first(prev: np.ndarray, prev2: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of a pair have no token in common among the two before theirs, whose list gives the pair too."""
    out = np.ones(len(i), bool)
    for x in (prev, prev2):
        for y in (prev, prev2):
            out &= (x[i] != y[j]) | (x[i] < 0)
    return out


def _starred(lists: DataFrame, num: int, den: int) -> DataFrame:
    """For each set the pair (a, b) of a pivot a and the set b with the most common prefix tokens, if sizes and that
    number allow the threshold: tokens beyond both prefixes add at most the longer rest."""
    pairs = lists.where("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"), F.col("pivot_n").alias("a_n"), F.col("n").alias("b_n"))
    need = f"ceil({num} * (a_n + b_n) / {num + den})"
    rest = f"greatest(floor({num} * a_n / {den}), floor({num} * b_n / {den}))"
    pairs = pairs.where(f"{den} * a_n >= {num} * b_n and {den} * b_n >= {num} * a_n").groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.count("*").alias("common"))
    best = pairs.where(f"common + {rest} >= {need}").groupBy("b").agg(F.max(F.struct("common", F.col("a"))).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b", F.col("best.a").alias("ra"), F.col("b").alias("rb"))


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs of round 1 with their cell: a pivot and its members, dealt to as many cells as they need."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    return pairs.join(load, "a").withColumn("cell", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts")))).drop("parts")


def _cells(token: np.ndarray, i: np.ndarray, j: np.ndarray, fp: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where pairs of a list are verified: the cells of one list, ordered by its token, hold one pair of its blocks, and
    sets of one size up to a factor of two, of which they take as many as have HELD tokens."""
    room = np.exp2(np.floor(np.log2(np.maximum(n, 1))) + 1).astype(np.int64)  # of each set at most
    deal = np.maximum(1, 2 * BLOCK * room // HELD)
    h = mix(mix((i.astype(np.uint64) << np.uint64(32)) + j.astype(np.uint64)) + mix(deal.astype(np.uint64)) + (fp % deal).astype(np.uint64))
    return (token & ~np.int64(0xFFFFF)) | (h & np.uint64(0xFFFFF)).astype(np.int64)


def _wanted(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """The rows of docs that may be among the doc_ids of roles, by a filter of FILTER bits at most; others of equal hash stay
    too, and a join follows."""
    docs, at = docs.withColumn("doc_id", F.col("doc_id").cast("long")), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    bits = roles.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    marked = docs.withColumn("at", at).withColumn("word", F.shiftright("at", 6)).join(F.broadcast(bits), "word")
    return marked.where("shiftrightunsigned(bits, cast(at & 63 as int)) & 1 = 1").select("doc_id", "text")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, apart: dict, width: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) in components ra and rb, those whose whole sets reach the threshold, as edges (a, b) of
    components: a forest per task. Texts meet by cell: each a of a cell goes there once and is held, each b goes there
    once, whatever the number of its pairs there, and passes by."""
    reps = nodes.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    held = pairs.select(F.col("a").alias("fp"), "cell", F.lit(0).alias("kind"), F.col("ra").alias("root")).distinct().withColumn("others", F.array().cast("array<long>"))
    passing = pairs.groupBy(F.col("b").alias("fp"), "cell", F.lit(1).alias("kind"), F.col("rb").alias("root")).agg(F.collect_list("a").alias("others"))
    roles = stage(docs.sparkSession, held.union(passing).join(reps, "fp"), "roles")
    rows = _wanted(docs, roles).join(roles, "doc_id").select("cell", "kind", "root", "fp", "others", "text").repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches):
        held, of = {}, None
        up: dict[int, int] = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for part, values, edge in _sets(batches, width):
            cell, kind, root, fp, others = (part.column(i).to_pylist() for i in range(5))
            (names, _), x, y = _prints(values, edge, apart), [], []
            for i, name in enumerate(names.tolist()):
                if name != fp[i]:  # another row of the same doc_id
                    continue
                if cell[i] != of:
                    held, of = {}, cell[i]
                mine = values[edge[i] : edge[i + 1]]
                if kind[i] == 0:
                    held[name] = mine.copy(), root[i]
                    continue
                for other in others[i]:
                    theirs, of_root = held[other]
                    if (r := top(of_root)) != (q := top(root[i])):
                        n, m = len(theirs), len(mine)
                        both = int((theirs[np.minimum(theirs.searchsorted(mine), n - 1)] == mine).sum()) if n and m else 0
                        if den * both >= num * (n + m - both):
                            up[max(r, q)] = min(r, q)
                            x.append(r)
                            y.append(q)
            if x:
                yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return rows.mapInArrow(run, "a long, b long").distinct()


def _across(lists: DataFrame, nodes: DataFrame, comp: DataFrame, tried: DataFrame, num: int, den: int, near: int, most: int | None, late: DataFrame | None = None) -> DataFrame:
    """Untried pairs (a, b, ra, rb, cell, more, old) of different components in one list, from the lists that hold two components or
    more. A list longer than BLOCK is dealt to pairs of its blocks.

    A pair that reaches the threshold shares a token among the first n - need + 1 of one set and m - need + 1 of the
    other, so that only such positions count; where both sets have a token in common among the two just before, that token's
    list gives the pair, and so on to the first token of a run that they share; a token at positions i and j allows an overlap of min(i, j) before it and
    min(n - i, m - j) from it on; and the sets' sketches, the longer one folded, differ in n + m - 2 * need bits at most. most: of a set's pairs
    with smaller ones in other components, only so many with the nearest sketches (more says that some were left out,
    old that a pair was tried and is there for that word only); None: all of them. late: sets (fp) that a round over all
    lists has left something out for; only their lists are looked at."""
    lists = lists.where("use = 2") if near == 1 else lists.where("use > 0").where(F.pmod(F.xxhash64("token"), F.lit(near)) == 0)
    lists = lists.select("token", "fp", "n", "pos", "prev", "prev2")
    if late is not None:
        lists = lists.join(lists.join(late, "fp", "left_semi").select("token").distinct(), "token", "left_semi")
    rows = lists.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("token", F.ceil(F.col("k") / BLOCK).cast("int").alias("nb"))
    rows = rows.join(open_, "token").join(nodes.groupBy("fp").agg(F.first("sketch").alias("sketch")), "fp")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    rows = rows.select("token", "fp", "n", "pos", "root", "mine", "prev", "prev2", "sketch", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    rows = rows.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "n", "pos", "root", "mine", "prev", "prev2", "sketch")
    ordered = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "fp")

    def near_pairs(i, j, token, left, right, fp, n, pos, root, mine, prev, prev2, sketch, wide, cross):
        """Of pairs of rows (j before i in one list), those that may reach the threshold."""
        apart = (root[i] != root[j]) & ~(cross[i] & (mine[i] == mine[j]))
        if near == 1:  # else the list of a token before holds both too, and gives the pair
            apart &= _first(prev, prev2, i, j)
        i, j = i[apart], j[apart]
        ok = _fits(n[i], n[j], pos[i], pos[j], num, den)
        i, j = i[ok], j[ok]
        need = _need(n[i], n[j], num, den)
        bits = _apart_bits(n, sketch, wide, i, j, n[i] + n[j] - 2 * need)
        fits = bits <= n[i] + n[j] - 2 * need
        i, j, bits = i[fits], j[fits], bits[fits]
        more = np.zeros(len(i), bool)
        if most is not None and len(i):
            order = np.lexsort((fp[j], bits, i))
            i, j, bits = i[order], j[order], bits[order]
            new = np.append(True, i[1:] != i[:-1])
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            more = np.append(rank[1:], 0) == most
            take = rank < most
            i, j, bits, more = i[take], j[take], bits[take], more[take]
        if len(i):
            yield pa.RecordBatch.from_arrays([*map(pa.array, (fp[j], fp[i], root[j], root[i], _cells(token[i], left[i], right[i], fp[j], n[j]))), pa.array(bits.astype(np.int32)), pa.array(more)], ["a", "b", "ra", "rb", "cell", "bits", "more"])

    def long_list(token, left, right, fp, n, pos, root, mine, prev, prev2, sketch, wide, cross):
        cut = np.arange(0, len(fp), SKIP)
        size, reach, behind = n[cut], np.maximum.reduceat(pos, cut), np.maximum.reduceat(n - pos, cut)
        largest = n[np.minimum(cut + SKIP, len(fp)) - 1]
        roots, of = np.unique(root, return_inverse=True)
        usual = roots[np.bincount(of).argmax()]  # most of a list is often one component: its sets are compared with others only
        other = root != usual
        others = np.logical_or.reduceat(other, cut)
        for k, lo in enumerate(cut.tolist()):  # a block of the list, sorted by size, against it and the blocks before
            hi = min(lo + SKIP, len(fp))
            use = (den * largest[: k + 1] >= num * size[k]) & (np.minimum(reach[k], reach[: k + 1]) + np.minimum(behind[k], behind[: k + 1]) >= _need(size[k], size[: k + 1], num, den))
            for rare in (False, True):
                x = lo + np.flatnonzero(other[lo:hi] == rare)
                y = (np.flatnonzero(use if rare else use & others[: k + 1])[:, None] * SKIP + np.arange(SKIP)).ravel()
                y = y[y < hi]
                y = y if rare else y[other[y]]
                if len(x) and len(y):
                    i, j = np.nonzero(y < x[:, None])
                    yield from near_pairs(x[i], y[j], token, left, right, fp, n, pos, root, mine, prev, prev2, sketch, wide, cross)

    def whole_lists(cols, starts):
        """Lists of up to SKIP rows all at once, longer ones one by one."""
        sizes = np.diff(np.append(starts, len(cols[0])))
        for k in np.flatnonzero(sizes > SKIP):
            yield from long_list(*[c[starts[k] : starts[k] + sizes[k]] for c in cols])
        start, at = np.repeat(starts, sizes), np.arange(len(cols[0]))
        yield from near_pairs(*_before(np.where(np.repeat(sizes, sizes) <= SKIP, at - start, 0), start), *cols)

    def run(batches):
        held = None  # rows of a list that may go on
        for b in batches:
            if not b.num_rows:
                continue
            t, i, j, *cols = (np.asarray(c) for c in b.columns[:-1])
            wide = b.column(b.num_columns - 1).to_pylist()
            cols = [t, i, j, *cols, _folded(wide, SKETCH), np.array(wide, object), i != j]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            t, i, j = cols[:3]
            starts = np.append(0, np.flatnonzero((t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1)
            if len(starts) > 1:
                yield from whole_lists([c[: starts[-1]] for c in cols], starts[:-1])
            held = [c[starts[-1] :] for c in cols]
        if held is not None:
            yield from whole_lists(held, np.zeros(1, np.int64))

    found = ordered.mapInArrow(run, "a long, b long, ra long, rb long, cell long, bits int, more boolean")
    found = found.groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("ra", "rb", "bits")], F.min("cell").alias("cell"), F.max("more").alias("more"))
    found = found.join(tried.distinct().withColumn("old", F.lit(True)), ["a", "b"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    if most is None:
        found = found.where("not old")
    else:
        w = Window.partitionBy("b")
        found = found.withColumns({"k": F.row_number().over(w.orderBy("old", "bits", "a")), "of": F.count_if(~F.col("old")).over(w), "any": F.max("more").over(w)})
        found = found.withColumn("more", F.col("any") | (F.col("of") > most)).where(f"not old and k <= {most} or old and more")
    return found.select("a", "b", "ra", "rb", "cell", "more", "old")


def _apart(nodes: DataFrame) -> dict[tuple[int, int], int]:
    """Other names for sets that share their first fingerprint with another set: all but the least second one of each
    such name. Names have 63 bits, so a corpus of n sets has n * n / 2^64 of them (five for ten thousand million)."""
    shared = nodes.groupBy("fp").agg(F.min("fp2").alias("lo"), F.max("fp2").alias("hi")).where("lo <> hi")
    rows = nodes.join(shared, "fp").where("fp2 <> lo").select("fp", "fp2").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise RuntimeError("too many sets share a fingerprint")
    out, taken = {}, set()
    for r in sorted(map(tuple, rows)):
        name = r[1] & (2**63 - 1)
        while name in taken or not name or nodes.where(F.col("fp") == name).limit(1).count():
            name = (name + 1) & (2**63 - 1)
        taken.add(name)
        out[r] = name
    return out


def _contracted(spark: SparkSession, comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) after edges (a, b) between roots: only the graph of roots is solved."""
    moved = stage(spark, components(spark, edges), "moved")
    after = comp.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(spark, after.union(moved.join(comp, "node", "left_anti").select("node", "root")), "comp")


def joined(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float | Fraction = Fraction(4, 5)) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null and empty texts have an empty set, which links with nothing; under width words the whole sequence is one
    shingle; repeated shingles count once; equal sets link at once, however many documents have them. Rows without a
    doc_id link with nothing and have no component (null); repeated rows give a row each; other columns of docs are not
    looked at; an empty table gives an empty one.
    """
    small_batches(spark)
    share = Fraction(threshold).limit_denominator(1000)
    num, den = share.numerator, share.denominator
    docs = docs.select("doc_id", "text")
    keyed = docs.where("doc_id is not null")

    every, table = _noted(spark, docs, width)
    apart = _apart(every)
    if apart:
        new = F.element_at(F.create_map(*[F.lit(x) for (f, g), name in apart.items() for x in (f"{f} {g}", name)]), F.concat_ws(" ", "fp", "fp2"))
        every = every.withColumn("fp", F.coalesce(new, "fp"))
    nodes = every.where("doc_id is not null and n > 0").select("doc_id", "fp", "n", "sketch")
    tables = spark.sparkContext.broadcast((_levels(table), _parts(table), apart))
    groups = 1 + int(table.sum()) * (den - num) // den // GROUP
    lists = stage(spark, _lists(_postings(keyed, tables, width, num, den, groups), num, den), "lists", free=True)
    pairs = stage(spark, _starred(lists, num, den), "pairs", free=True)
    comp = _contracted(spark, spark.createDataFrame([], "node long, root long"), stage(spark, _verified(keyed, nodes, _stars(pairs), apart, width, num, den), "links", free=True))
    tried = pairs.select("a", "b")  # the set that comes first by size and name is always a
    late = None
    for near, most in ROUNDS:
        found = stage(spark, _across(lists, nodes, comp, tried, num, den, near, most, late), "pairs", free=True)
        pairs = found.where("not old")
        some, left = found.agg(F.count_if(~F.col("old")), F.max("more")).first()
        if some:
            comp = _contracted(spark, comp, stage(spark, _verified(keyed, nodes, pairs, apart, width, num, den), "links", free=True))
            tried = tried.union(pairs.select("a", "b"))
        if near == 1 and not left:
            break
        late = found.where("more").select(F.col("b").alias("fp")).distinct() if near == 1 else None
    class_of = nodes.groupBy("fp").agg(F.min("doc_id").alias("least")).join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = class_of.join(least, "root").select("fp", "component_id")
    whole = every.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("fp")).alias("fp"))
    return whole.join(of_set, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
