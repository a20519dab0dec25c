"""Removal of passages that repeat anywhere in the corpus, by a radix sort of suffixes to a limited depth.

Only the first `width` bytes of a suffix matter: groups of suffixes that are equal to that depth are exactly the repeated
windows. A sort of all suffixes would move every byte `width` times, so a sieve first lets go of those that are alone:

1. Sieve. Every window of `width` bytes has an anchor, the least of its 32-byte grams in a fixed random order, a function of
   the window alone. Neighbouring windows mostly share it, so that one row stands for a run of them (about 85 on prose).
   Windows whose anchor occurs once are alone and never enter the sort. Runs that agree in all their bytes (by 128 bits)
   repeat as a whole; one of them stays to be compared with the other runs of its anchor.
2. Sort. What is left is sorted by its bytes, most significant digit first: suffixes are dealt out by anchor and the
   anchor's place in them, then by digit after digit of eight bytes; a suffix that is alone in its group leaves, and groups
   of two or more after the last digit are repeated windows. A group is split by a digit only if its members differ in it.
3. Anchors with many different runs are spread: each of their suffixes is a row of its own, dealt out by all of its bytes
   and sorted by them.

A task sends no more than two rows of the same run or suffix; from the third on it knows that they repeat. Spans of a
document are merged as they arrive.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup_join, pieces, small_batches, stage, utf8
from tidemark.llm.hashing import blocks, mix, ranges

#: Bytes of a gram that can be an anchor.
GRAM = 32
#: Bits for positions beside the hash while the least gram is sought: longer texts are cut by _cut_runs().
POSITION = 28
#: Different runs of one anchor that are sorted inside a task; the suffixes of larger groups are spread.
FEW = 2048
#: Suffixes that a task sorts at a time.
SORTED = 500_000
#: Runs or suffixes that a task remembers having sent; beyond that it forgets, and copies make some more rows.
SEEN = 1_000_000

_weights = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _grams(raw: np.ndarray) -> np.ndarray:
    """The order of the 32-byte grams: a hash of the four blocks of each, mixed before and after they are added up."""
    p = mix(blocks(raw)[:-1] + np.uint64(1))
    n = len(raw) - GRAM + 1
    return mix(sum(p[8 * k : 8 * k + n] * w for k, w in enumerate(_weights)))


def _runs(raw: np.ndarray, offs: np.ndarray, width: int):
    """Runs of windows with the same anchor: row, start in the row, length, the anchor's order, its place behind the
    start, and two hashes of the bytes of the run."""
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none.astype(np.uint64), none, none.astype(np.uint64), none.astype(np.uint64)
    gram = _grams(raw)
    low = np.uint64((1 << POSITION) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span, size, n = width - GRAM + 1, 1, len(raw) - width + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size : span - size + n])
    long = np.flatnonzero(np.diff(offs) >= width)
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[offs[long]] += 1
    mark[offs[long + 1] - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(mark[:n]))
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    end = start + count + width - 1
    anchor = (key[first] & low).astype(np.int64)
    view = blocks(raw)
    row = np.searchsorted(offs, start, "right") - 1
    return row, start - offs[row], count, gram[anchor], anchor - start, ranges(raw, start, end, 0, view), ranges(raw, start, end, 1, view)


def _cut_runs(raw: np.ndarray, offs: np.ndarray, width: int):
    """_runs() of rows of any length: where there are more bytes than positions, row by row, in pieces that overlap by
    width - 1 bytes. A run over a cut makes two."""
    most = 1 << POSITION
    if len(raw) <= most:
        yield _runs(raw, offs, width)
        return
    for i, (lo, hi) in enumerate(zip(offs.tolist(), offs[1:].tolist())):
        for at in range(lo, hi - width + 1, most - width + 1):
            piece = raw[at : min(at + most, hi)]
            row, start, *rest = _runs(piece, np.array([0, len(piece)], np.int64), width)
            yield row + i, start + (at - lo), *rest


class _Sent:
    """Which keys a task has sent: from the third time on, a key is known to repeat."""

    def __init__(self):
        self.times: dict = {}

    def known(self, keys: list) -> np.ndarray:
        if len(self.times) > SEEN:
            self.times.clear()
        times, out = self.times, np.zeros(len(keys), bool)
        for i, k in enumerate(keys):
            n = times.get(k, 0)
            if n < 2:
                times[k] = n + 1
            else:
                out[i] = True
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def _all_runs(keyed: DataFrame, width: int) -> DataFrame:
    def run(batches):
        sent = _Sent()
        for b in batches:
            raw, offs = utf8(b.column(2))
            for lo, hi in pieces(offs):
                for row, start, count, digit, at, one, two in _cut_runs(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], width):
                    take = pa.array(row + lo)
                    known = sent.known(list(zip(one.tolist(), two.tolist())))
                    rk = b.column(1).take(take)
                    deal = np.where(known, mix(np.asarray(rk).view(np.uint64) + start.astype(np.uint64)), digit).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(deal), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), b.column(0).take(take), rk, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(known)],
                        ["digit", "one", "two", "doc_id", "rk", "start", "count", "at", "known"],
                    )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select("doc_id", "rk", "text").mapInArrow(run, f"digit long, one long, two long, doc_id {kind}, rk long, start int, count int, at int, known boolean")


def _settled(runs: DataFrame) -> DataFrame:
    """Runs in the order of their anchor and their bytes, seen once, remembering one row: kind 0 repeats as a whole; kind 1
    is the first run of its bytes at an anchor with two or more different ones."""

    def run(batches):
        last = None  # one-row batch; whether it heads its bytes; its anchor's first row; whether that went out
        for b in batches:
            out = []
            known = np.asarray(b.column(b.num_columns - 1))
            if known.any():
                out.append((b.filter(pa.array(known)), 0))
                b = b.filter(pa.array(~known))
            if b.num_rows:
                d, x, y = (np.asarray(b.column(i)) for i in range(3))
                n = len(d)
                same_d, same = np.zeros(n, bool), np.zeros(n, bool)
                same_d[1:] = d[1:] == d[:-1]
                same[1:] = same_d[1:] & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                if last is not None:
                    was = [last[0].column(i)[0].as_py() for i in range(3)]
                    same_d[0] = was[0] == d[0]
                    same[0] = same_d[0] and was[1] == x[0] and was[2] == y[0]
                head = ~same
                second = same & np.concatenate([[bool(last and last[1])], head[:-1]])
                if second[0]:
                    out.append((last[0], 0))
                twice = same.copy()
                twice[np.flatnonzero(second[1:])] = True  # the heads before them
                if twice.any():
                    out.append((b.take(pa.array(np.flatnonzero(twice))), 0))
                other = head & same_d  # further bytes at the anchor
                group = np.maximum.accumulate(np.where(~same_d, np.arange(n), -1))
                firsts = np.unique(group[other])
                if len(firsts) and firsts[0] < 0:
                    if not last[3]:
                        out.append((last[2], 1))
                    firsts = firsts[1:]
                chosen = np.concatenate([np.flatnonzero(other), firsts])
                if len(chosen):
                    out.append((b.take(pa.array(chosen)), 1))
                g = group[-1]
                sent = bool((group[other] == g).any()) or (g < 0 and bool(last[3]))
                last = (b.slice(n - 1, 1), bool(head[-1]), b.slice(int(g), 1) if g >= 0 else last[2], sent)
            for part, kind in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, kind, np.int32)), *[part.column(i) for i in (0, 3, 4, 5, 6, 7)]], ["kind", "digit", "doc_id", "rk", "start", "count", "at"])

    kind = runs.schema["doc_id"].dataType.simpleString()
    return runs.repartition("digit").sortWithinPartitions("digit", "one", "two").mapInArrow(run, f"kind int, digit long, doc_id {kind}, rk long, start int, count int, at int")


def _cut(keyed: DataFrame, open_: DataFrame, width: int) -> DataFrame:
    """The open runs with their bytes, fetched from their texts: one list of runs per text meets it."""
    lists = open_.groupBy("doc_id", "rk").agg(F.collect_list(F.struct("digit", "start", "count", "at", "many")).alias("runs"))
    lists = lists.withColumnRenamed("doc_id", "of_id").withColumnRenamed("rk", "of_rk")
    once = keyed.join(lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("rk") == F.col("of_rk"))).select("doc_id", "rk", "text", "runs")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, offs = utf8(b.column(2))
            lists = b.column(3)
            flat, edge = lists.flatten(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            row = np.repeat(np.arange(b.num_rows), np.diff(edge))
            digit, start, count, at, many = (flat.field(i) for i in range(5))
            a = np.asarray(start) + offs[row]
            e = a + np.asarray(count) + width - 1
            data = pa.array([raw[x:y].tobytes() for x, y in zip(a, e)], pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([digit, many, b.column(0).take(take), b.column(1).take(take), start, count, at, data], ["digit", "many", "doc_id", "rk", "start", "count", "at", "data"])

    return once.mapInArrow(run, f"digit long, many boolean, doc_id {kind}, rk long, start int, count int, at int, data binary")


def _ramp(count: np.ndarray) -> np.ndarray:
    """0..c-1 for each c."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _raw(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offs, buf = data.buffers()
    o = np.frombuffer(offs, np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(buf, np.uint8)[o[0] : o[-1]], o - o[0]


def radix(raw: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the suffixes of raw at the positions at agree in their first width bytes with another one of their group:
    most significant digit first, eight bytes a digit. What is alone in its group leaves."""
    hit, view = np.zeros(len(at), bool), blocks(raw)
    order = np.argsort(group, kind="stable")
    new = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
    for k in range(-8, width, 8):
        if k >= 0:
            key = view[at[order] + k].byteswap()
            if width - k < 8:
                key >>= np.uint64(8 * (8 - width + k))
            owner, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            differs = np.zeros(len(heads), bool)
            differs[owner[key != key[heads][owner]]] = True
            mixed = np.flatnonzero(differs[owner])
            if len(mixed):  # only groups whose members differ in this digit are put in order and split
                inner = mixed[np.lexsort((key[mixed], owner[mixed]))]
                order[mixed], key[mixed] = order[inner], key[inner]
                new[1:] |= key[1:] != key[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        keep = np.repeat(size > 1, size)
        order, new = order[keep], new[keep]
        if not len(order):
            break
    hit[order] = True
    return hit


def _spans(part: pa.RecordBatch, hit: np.ndarray, row: np.ndarray, count: np.ndarray):
    """Runs of hit suffixes as (doc_id, rk, start, count)."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    r = row[at[first]]
    start = np.asarray(part.column(4))[r] + _ramp(count)[at[first]]
    take = pa.array(r)
    return pa.RecordBatch.from_arrays([part.column(2).take(take), part.column(3).take(take), pa.array(start.astype(np.int32)), pa.array(np.diff(np.append(first, len(at))).astype(np.int32))], ["doc_id", "rk", "start", "count"])


def _sorted(few: DataFrame, width: int) -> DataFrame:
    """Repeated suffixes of anchors with few runs: whole anchors come together and leave as spans."""

    def judge(held: list[pa.RecordBatch]):
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        digit, count, at = np.asarray(part.column(0)), np.asarray(part.column(5)).astype(np.int64), np.asarray(part.column(6))
        raw, offs = _raw(part.column(7))
        anchor = np.cumsum(np.append(False, digit[1:] != digit[:-1]))
        row, k = np.repeat(np.arange(len(count)), count), _ramp(count)
        hit = radix(raw, offs[row] + k, anchor[row] * width + (at[row] - k), width)
        if hit.any():
            yield _spans(part, hit, row, count)

    def run(batches):
        held, n, of = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            d, count = np.asarray(b.column(0)), np.asarray(b.column(5)).astype(np.int64)
            cuts = np.flatnonzero(d[1:] != d[:-1]) + 1
            cut = int(cuts[-1]) if len(cuts) else 0  # where the batch's last anchor begins
            if cut or (held and d[0] != of):
                held.append(b.slice(0, cut))
                n += int(count[:cut].sum())
                if n > SORTED:
                    yield from judge(held)
                    held, n = [], 0
            held.append(b.slice(cut))
            n += int(count[cut:].sum())
            of = d[-1]
        if held:
            yield from judge(held)

    kind = few.schema["doc_id"].dataType.simpleString()
    return few.repartition("digit").sortWithinPartitions("digit").mapInArrow(run, f"doc_id {kind}, rk long, start int, count int")


def _spread(many: DataFrame, width: int) -> DataFrame:
    """Repeated suffixes of anchors with many runs: each suffix is a row, dealt out by all its bytes and sorted by them."""
    kind = many.schema["doc_id"].dataType.simpleString()

    def run(batches):
        sent = _Sent()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                count = np.asarray(part.column(5)).astype(np.int64)
                raw, offs = _raw(part.column(7))
                row, k, whole = np.repeat(np.arange(len(count)), count), _ramp(count), raw.tobytes()
                suffix = [whole[a : a + width] for a in (offs[row] + k).tolist()]
                prints = [xxhash.xxh3_128_intdigest(s) for s in suffix]
                known = sent.known(prints)
                take, start = pa.array(row), np.asarray(part.column(4))[row] + k
                deal = np.array([p & (2**64 - 1) for p in prints], np.uint64)
                deal[known] = mix(deal[known] + start[known].astype(np.uint64) + np.asarray(part.column(3))[row[known]].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array([None if x else s for s, x in zip(suffix, known.tolist())], pa.binary()), part.column(2).take(take), part.column(3).take(take), pa.array(start.astype(np.int32))], ["deal", "suffix", "doc_id", "rk", "start"])

    def equal(batches):
        last = None  # one-row batch, whether it went out
        for b in batches:
            known = b.column(1).is_null()  # the third one and further ones of a task
            parts = [b.filter(known)]
            b = b.filter(pc.invert(known))
            if b.num_rows:
                s = b.column(1)
                same = np.zeros(b.num_rows, bool)
                same[1:] = np.asarray(pc.equal(s.slice(1), s.slice(0, b.num_rows - 1)))
                same[0] = last is not None and last[0].column(1)[0] == s[0]
                out = same.copy()
                out[:-1] |= same[1:]
                parts.append(b.filter(pa.array(out)))
                if same[0] and not last[1]:
                    parts.append(last[0])
                last = (b.slice(b.num_rows - 1), bool(out[-1]))
            for p in parts:
                yield pa.RecordBatch.from_arrays([*p.columns[2:], pa.array(np.ones(p.num_rows, np.int32))], ["doc_id", "rk", "start", "count"])

    single = many.mapInArrow(run, f"deal long, suffix binary, doc_id {kind}, rk long, start int")
    return single.repartition("deal").sortWithinPartitions("deal", "suffix").mapInArrow(equal, f"doc_id {kind}, rk long, start int, count int")


def spans(spark: SparkSession, docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, rk, start, count): count suffixes from start on, in bytes, whose first width bytes start elsewhere too.
    rk tells rows with one doc_id and different texts apart; repeated rows share their spans."""
    keyed = _keyed(docs)
    marks = stage(spark, _settled(_all_runs(keyed, width)), "marks", free=True)
    open_ = marks.where("kind = 1").drop("kind")
    crowded = stage(spark, open_.groupBy("digit").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("digit", F.lit(True).alias("many")), "crowded")
    open_ = lookup_join(open_, crowded, ["digit"]).withColumn("many", F.coalesce("many", F.lit(False)))
    cut = stage(spark, _cut(keyed, open_, width), "cut", free=True)
    whole = marks.where("kind = 0").select("doc_id", "rk", "start", "count")
    return whole.union(_sorted(cut.where("not many"), width)).union(_spread(cut.where("many"), width))


def _merged(found: DataFrame, width: int) -> DataFrame:
    """(of_id, of_rk, runs): for each text with spans, the maximal removed runs of bytes. Spans come in order and are
    merged as they arrive, so that a task holds one text's runs."""
    kind = found.schema["doc_id"].dataType.simpleString()
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        of, cuts, ids, rks, lists = None, [], [], [], []
        for b in batches:
            for i, rk, start, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if (i, rk) != of:
                    if cuts:
                        ids.append(of[0])
                        rks.append(of[1])
                        lists.append(cuts)
                    of, cuts = (i, rk), []
                end = start + count + width - 1
                if cuts and start <= cuts[-1]["end"]:
                    cuts[-1]["end"] = max(end, cuts[-1]["end"])
                else:
                    cuts.append({"start": start, "end": end})
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(rks, pa.int64()), pa.array(lists, runs)], ["of_id", "of_rk", "runs"])
                ids, rks, lists = [], [], []
        if cuts:
            yield pa.RecordBatch.from_arrays([pa.array([of[0]], b.schema.field(0).type), pa.array([of[1]], pa.int64()), pa.array([cuts], runs)], ["of_id", "of_rk", "runs"])

    ordered = found.repartition("doc_id", "rk").sortWithinPartitions("doc_id", "rk", "start")
    return ordered.mapInArrow(run, f"of_id {kind}, of_rk long, runs array<struct<start: int, end: int>>")


def removed(spark: SparkSession, docs: DataFrame, width: int = 200) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (starts and ends of the removed
    runs in bytes); one row per row of docs.

    Each byte covered by a width-byte string that also starts elsewhere in the corpus goes, in every place; null and
    empty texts have no bytes; texts under width bytes keep all of theirs. Repeated rows repeat each other, so they lose
    what is width bytes long or more. Rows without a doc_id are texts like others. Texts of any length are cut up where
    positions would not fit. An empty table gives an empty one; other columns are not looked at.
    """
    small_batches(spark)
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} at least")
    docs = docs.select("doc_id", "text")
    lists = stage(spark, _merged(spans(spark, docs, width), width), "spans", free=True)
    pairs = _keyed(docs).join(lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("rk") == F.col("of_rk")), "left").select("doc_id", "text", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, offs = utf8(b.column(1))
            n_removed, n_spans, digest, runs = [], [], [], []
            for i, cuts in enumerate(b.column(2).to_pylist()):
                text, cuts, sha, at = raw[offs[i] : offs[i + 1]], cuts or [], hashlib.sha256(), 0
                for c in cuts:
                    sha.update(text[at : c["start"]].tobytes())
                    at = c["end"]
                sha.update(text[at:].tobytes())
                n_removed.append(sum(c["end"] - c["start"] for c in cuts))
                n_spans.append(len(cuts))
                digest.append(sha.hexdigest())
                runs.append(cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return pairs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>")
