"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network in numpy, and probabilities
calibrated by a temperature.

Random indexing: every token has a fixed sparse ternary index vector; a token's word vector is the sum of the index
vectors around its occurrences, over all documents. Tokens are hashed to a fixed number of rows, so that the table is
the same size for every corpus; tasks add up their own table and only tables are merged. Two kinds of tokens are
indexed: words, and their shapes (runs of lower-case letters, capitals, digits, and other characters as they are), which
say something about words that occur once. A document is the mean of its tokens' vectors, tokens weighing less the more
frequent they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup_join, pieces, small_batches, stage, utf8
from tidemark.llm.hashing import ranges, words

ROWS = (16384, 1024)  # rows of the tables of words and of shapes
DIM = 32  # length of a vector
NONZERO = 6  # of an index vector
AROUND = (-2, -1, 1, 2)
#: Labelled documents that the network is fitted on at most, chosen by hash of their key.
LABELLED = 20_000

_class = np.arange(256, dtype=np.uint8)
_class[97:123] = 97
_class[65:91] = 65
_class[48:58] = 48
_class[128:] = 97


def index_vectors(rows: int, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((rows, DIM), np.int8)
    for k in range(NONZERO):
        out[np.arange(rows), rng.integers(0, DIM, rows)] = 1 - 2 * (k % 2)
    return out


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each word, and its row in the tables of words and of shapes."""
    a, b, h = words(raw, offs, False)
    row = np.searchsorted(offs, a, "right") - 1
    kind = _class[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[a] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = ranges(kind[keep], at[a], at[b])
    return row, [(h % np.uint64(ROWS[0])).astype(np.int64), (shape % np.uint64(ROWS[1])).astype(np.int64)]


def _slices(batches):
    for b in batches:
        raw, offs = utf8(b.column(b.schema.get_field_index("text")))
        for lo, hi in pieces(offs):
            row, tokens = _tokens(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield b.slice(lo, hi - lo), row, tokens


def indexed(docs: DataFrame) -> list[np.ndarray]:
    """The two tables of word vectors (unit length, times a weight that falls with frequency), over all documents."""
    size = [r * (DIM + 1) for r in ROWS]
    blocks = 32

    def add_up(batches):
        tables = [np.zeros((r, DIM + 1), np.int64) for r in ROWS]
        index = [index_vectors(r, k) for k, r in enumerate(ROWS)]
        for _, row, tokens in _slices(batches):
            for table, vectors, t in zip(tables, index, tokens):
                if not len(t):
                    continue
                near = np.zeros((len(t), DIM + 1), np.int32)
                near[:, DIM] = 1
                for o in AROUND:
                    mine, other = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
                    near[mine, :DIM] += vectors[t[other]] * (row[mine] == row[other])[:, None]
                order = np.argsort(t, kind="stable")
                first = np.flatnonzero(np.append(True, t[order][1:] != t[order][:-1]))
                table[t[order][first]] += np.add.reduceat(near[order], first)
        flat = np.concatenate([t.ravel() for t in tables])
        if flat.any():
            parts = np.array_split(flat, blocks)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v, np.int64)
                total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"block": pa.array(total, pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    kind = "block int, sums binary"
    got = {r["block"]: np.frombuffer(r["sums"], np.int64) for r in docs.select("text").mapInArrow(add_up, kind).repartition(blocks, "block").mapInArrow(merge, kind).toLocalIterator()}
    flat = np.concatenate([got[k] for k in range(blocks)]) if got else np.zeros(sum(size), np.int64)
    out = []
    for r, part in zip(ROWS, np.split(flat, [size[0]])):
        table = part.reshape(r, DIM + 1).astype(np.float64)
        n, v = table[:, DIM], table[:, :DIM]
        v = v - v.sum(0) / max(n.sum(), 1) * n[:, None]  # what all contexts share says nothing
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)
        share = n / max(n.sum(), 1)
        out.append((v * (1e-2 / (1e-2 + share))[:, None]).astype(np.float32))
    return out


def pooled(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """(key, vector): the mean of the word vectors and of the shape vectors of each whole text; zeros where it has no
    words. Labels and other columns are not looked at."""
    tables = spark.sparkContext.broadcast(indexed(docs))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part, row, tokens in _slices(batches):
            n = part.num_rows
            x = np.zeros((n, 2 * DIM), np.float32)
            for k, (table, t) in enumerate(zip(tables.value, tokens)):
                if len(t):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    x[row[first], k * DIM : (k + 1) * DIM] = np.add.reduceat(table[t], first) / np.diff(np.append(first, len(t)))[:, None]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 2 * DIM), pa.array(x.ravel()))], [key, "vector"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, vector array<float>")


class Network:
    """Two layers (tanh, then a logit), fitted by Adam on standardised inputs; the temperature is fitted on rows that the
    layers have not seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.dev = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
        self.heat = 1.0
        self.w = [rng.normal(0, (2 * DIM) ** -0.5, (2 * DIM, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        if not len(x) or y.min() == y.max():  # nothing to tell apart: the labels' mean, or one half
            self.w = [np.zeros_like(w) for w in self.w]
            self.w[3][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(x) else 0.0
            return
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        held, train = order[:cut], order[cut:]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for i in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
                z = (x[i] - self.mean) / self.dev
                h = np.tanh(z @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[i]) / max(len(i), 1)
                g = np.outer(d, self.w[2]) * (1 - h * h)
                step += 1
                for k, grad in enumerate((z.T @ g + decay * self.w[0], g.sum(0), h.T @ d + decay * self.w[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        logit, heats = self.logit(x[held]), np.exp(np.linspace(-2, 3, 201))
        loss = [np.logaddexp(0, -np.where(y[held] > 0.5, logit, -logit) / t).mean() for t in heats]
        self.heat = float(heats[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.dev @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.heat, -30, 30)))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = LABELLED) -> DataFrame:
    """docs (key, text), labels (key, quality) -> key, held_out, score, predicted; one row per row of docs.

    held_out is crc32(key as text) mod 3 = 1; the network sees labels of the other rows only, most of them at most,
    taken by hash. Null labels are left out; several labels of a key count as their mean, rounded. Null and empty texts
    get the score of a text without words. Word vectors come from all documents. An empty table gives an empty one.
    """
    small_batches(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    vectors = stage(spark, pooled(spark, docs, key).withColumn("held_out", held), "vectors")
    known = labels.where("quality is not null").groupBy(key).agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    sample = known.withColumn("held_out", held).where("not held_out").orderBy(F.xxhash64(key), key).limit(most).select(key, "quality")
    # one vector per key, the least of several, so that repeated rows do not multiply the bounded sample
    rows = lookup_join(vectors, sample, [key], "inner").groupBy(key).agg(F.min("vector").alias("vector"), F.first("quality").alias("quality")).orderBy(key).select("vector", "quality").toPandas()
    x = np.array(rows["vector"].tolist(), np.float64).reshape(-1, 2 * DIM)
    net = Network(x, rows["quality"].to_numpy(np.float64))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = np.asarray(b.column(2).flatten()).astype(np.float64).reshape(-1, 2 * DIM)
            s = net.score(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return vectors.select(key, "held_out", "vector").mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
