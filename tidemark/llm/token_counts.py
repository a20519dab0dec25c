"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its pre-tokens. The tree's leaves are
runs of LEAF pre-tokens (characters and tokens of each), its inner nodes are sums. An edit splits pre-tokens anew from
the last boundary that it can have moved until a boundary falls on an old one again, encodes only what lies between and
what else is in its first and last leaf, and updates the leaves it touched and the sums above them. Leaves take in what an
edit inserts until they are full, so that the tree is seldom built again.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: Pre-tokens that a leaf grows to before the leaves around an edit are cut anew and the tree is built again.
FULL = 4 * LEAF


class Counter:
    """Tokens of pre-tokens; remembers up to MOST of them."""

    MOST = 500_000

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.code = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.code.encode_ordinary(p))
        return [known[p] for p in parts]


@lru_cache(2)
def counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class Tree:
    """A text's leaves as [characters, tokens, lengths of pre-tokens], and sums over them in a binary tree."""

    def __init__(self, code: Counter, text: str, leaves: list[list] | None = None):
        self.code, self.text = code, text
        self.encoded = 0  # characters encoded by edits so far
        self.leaves = self._made(code.split.findall(text)) if leaves is None else leaves
        self._sum()

    def _made(self, parts: list[str]) -> list[list]:
        n = self.code.count(parts)
        return [[sum(len(p) for p in parts[i : i + LEAF]), sum(n[i : i + LEAF]), [len(p) for p in parts[i : i + LEAF]]] for i in range(0, len(parts), LEAF)]

    def _sum(self) -> None:
        self.size = 1
        while self.size < max(len(self.leaves), 1):
            self.size *= 2
        self.sums = [(0, 0)] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.size + i] = (leaf[0], leaf[1])
        for i in range(self.size - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and where it begins."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.sums[i][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.size, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end by new."""
        old = self.text
        start, end = max(0, min(start, len(old))), max(0, min(max(start, end), len(old)))
        text = old[:start] + new + old[end:]
        if not self.leaves or not text:
            self.text, self.leaves = text, self._made(self.code.split.findall(text))
            self.encoded += len(text)
            return self._sum()
        # the pre-token that reaches start, or white space that goes on up to it, is the first that can change
        near = start
        while near and old[near - 1].isspace():
            near -= 1
        # an apostrophe before one letter: a second one can make both a contraction
        if near > 1 and old[near - 2] == "'":
            near -= 1
        first, begin = self._leaf_at(max(near - 1, 0))
        at, k = begin, 0
        while k < len(self.leaves[first][2]) and at + self.leaves[first][2][k] < near:
            at += self.leaves[first][2][k]
            k += 1
        # split anew until a boundary beyond the edit is an old one, moved by the edit's growth
        grown, parts, pos, edge = len(new) - (end - start), [], at, start + len(new)
        last, old_at, j = first, at, k
        done = False
        for m in self.code.split.finditer(text, at):
            parts.append(m.group())
            pos = m.end()
            while last < len(self.leaves) and old_at + grown < pos:
                if j < len(self.leaves[last][2]):
                    old_at += self.leaves[last][2][j]
                    j += 1
                if j >= len(self.leaves[last][2]):
                    last, j = last + 1, 0
            if pos > edge and old_at + grown == pos and old_at >= end:
                done = True
                break
        if not done:
            last, j = len(self.leaves), 0
        n = self.code.count(parts)
        head, tail = self.leaves[first][2][:k], self.leaves[last][2][j:] if last < len(self.leaves) and j else []
        # tokens of what stays of the first and the last leaf: encoded anew, a leaf at most each
        before = [old[begin + sum(head[:i]) : begin + sum(head[: i + 1])] for i in range(len(head))]
        after, p = [], pos
        for size in tail:
            after.append(text[p : p + size])
            p += size
        counts = self.code.count(before) + n + self.code.count(after)
        lengths = head + [len(x) for x in parts] + tail
        self.encoded += sum(lengths)
        self.text = text
        upto = last + 1 if j else last
        same = len(lengths) <= FULL * (upto - first)
        step = max(-(-len(lengths) // (upto - first)), 1) if same else LEAF
        cuts = [i * step for i in range(upto - first)] if same else range(0, len(lengths), LEAF)
        made = [[sum(lengths[i : i + step]), sum(counts[i : i + step]), lengths[i : i + step]] for i in cuts]
        self.leaves[first:upto] = made
        if same:  # the tree keeps its form: only paths from the touched leaves to the root change
            for i, leaf in enumerate(made):
                self._set(first + i, (leaf[0], leaf[1]))
        else:
            self._sum()

    def _set(self, i: int, value: tuple[int, int]) -> None:
        i += self.size
        self.sums[i] = value
        while i > 1:
            i //= 2
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)


TREE = "array<struct<chars: int, tokens: int, parts: array<int>>>"
EDITS = "array<struct<start: int, end: int, text: string>>"


def counted(spark: SparkSession, docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs (..., text) with n_tokens and tree (the leaves) beside its columns, which give way where named so. Null and
    empty texts have no tokens and an empty tree."""
    small_batches(spark)
    with open(path, "rb") as f:
        ranks = f.read()
    docs = docs.drop("n_tokens", "tree")
    at = docs.columns.index("text")

    def run(batches):
        code = counter(ranks)
        for b in batches:
            trees = [Tree(code, t or "") for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.tokens for t in trees], pa.int64()), _arrow([t.leaves for t in trees])], [*b.schema.names, "n_tokens", "tree"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *spark.createDataFrame([], f"n_tokens long, tree {TREE}").schema.fields]))


def _arrow(trees: list[list[list]]) -> pa.Array:
    kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32()), ("parts", pa.list_(pa.int32()))]))
    return pa.array([[{"chars": a, "tokens": b, "parts": c} for a, b, c in leaves] for leaves in trees], kind)


def edited(spark: SparkSession, docs: DataFrame, path: str = RANKS) -> DataFrame:
    """docs (..., text, tree, n_tokens, edits) with text, tree and n_tokens brought up to date and a column encoded:
    characters that were encoded anew, leaves' rests included. edits (start, end, text) apply one after the other, in code points of the text
    as the edits before have left it; null edits, and null parts of one, change nothing. A null tree is built first."""
    small_batches(spark)
    with open(path, "rb") as f:
        ranks = f.read()
    docs = docs.drop("encoded")
    text_at, tree_at, count_at, edits_at = (docs.columns.index(c) for c in ("text", "tree", "n_tokens", "edits"))

    def run(batches):
        code = counter(ranks)
        for b in batches:
            texts, trees = [], []
            for text, leaves, edits in zip(b.column(text_at).to_pylist(), b.column(tree_at).to_pylist(), b.column(edits_at).to_pylist()):
                tree = Tree(code, text or "", None if leaves is None else [[x["chars"], x["tokens"], x["parts"]] for x in leaves])
                for e in edits or []:
                    if e and None not in e.values():
                        tree.edit(e["start"], e["end"], e["text"])
                texts.append(None if text is None and not tree.text else tree.text)
                trees.append(tree)
            cols = list(b.columns)
            cols[text_at], cols[tree_at] = pa.array(texts, pa.string()), _arrow([t.leaves for t in trees])
            cols[count_at] = pa.array([t.tokens for t in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t.encoded for t in trees], pa.int64())], [*b.schema.names, "encoded"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *spark.createDataFrame([], "encoded long").schema.fields]))


def sample_edits(key: Column, length: Column, n: int = 3) -> Column:
    """n replacements of eight characters at places that follow from a key by hash: edits for tests and the query."""
    one = lambda i: F.pmod(F.xxhash64(key.cast("string"), F.lit(i)), F.greatest(length, F.lit(1))).cast("int")
    return F.array(*[F.struct(one(i).alias("start"), (one(i) + 8).alias("end"), F.lit(f"[edit {i}]").alias("text")) for i in range(n)])


def digest(spark: SparkSession, docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, encoded: every document counted, edited, and counted again."""
    rows = counted(spark, docs.select("doc_id", "text"), path).withColumn("before", F.col("n_tokens")).withColumn("edits", sample_edits(F.col("doc_id"), F.length("text")))
    return edited(spark, rows, path).select("doc_id", F.col("before").alias("n_tokens"), F.size("edits").cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), "encoded")
