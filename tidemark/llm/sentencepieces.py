"""SentencePiece models on the tokenizers library: the model file is parsed here, its normaliser, white-space marker,
scores and byte fallback are rebuilt, and batches are encoded by the library's threads.

Both model types are covered: unigram (scores as they are) and BPE (each way of making a piece from two others is a
merge, in the order of the pieces' scores). Ids are those of the tokenizers library. They are held against the
sentencepiece library, word by word where the model never joins words, else whole texts; where the two differ, the row
says so and keeps its ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tidemark.llm.common import pieces, small_batches, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Field numbers and enums of the model format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, or bytes."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    """What a model file says: pieces with scores and kinds, its type, and how text is normalised."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unk, self.byte_fallback, self.suffix = UNIGRAM, 0, False, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == PIECE:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == TRAINER:
                f = dict(_fields(value))
                self.kind, self.unk = f.get(3, UNIGRAM), f.get(40, 0)
                self.suffix, self.byte_fallback = bool(f.get(24, 0)), bool(f.get(35, 0))
            elif number == NORMALIZER:
                f = dict(_fields(value))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with an escaped, leading white-space marker are covered")

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make another piece; better scores first, then shorter left parts."""
        usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
        made = sorted(((score, p) for p, score, kind in self.pieces if kind == NORMAL and len(p) > 1), key=lambda x: -x[0])
        return [(p[:i], p[i:]) for _, p in made for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]

    def tokenizer(self):
        """The tokenizer of the tokenizers library that encodes and decodes as this model does."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        else:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        user = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if user:
            t.add_tokens(user)
        return t


    def apart(self) -> bool:
        """Whether texts can be encoded word by word: no normalisation besides the marker, and no piece that goes on
        with a marker after another character, so that nothing is ever merged across words."""
        return not (self.charsmap or self.squeeze or not self.dummy_prefix or self.kind != BPE) and not any(MARK in p.lstrip(MARK) or kind == USER for p, _, kind in self.pieces if kind in (NORMAL, USER))


BYTE_PIECE = re.compile("<0x[0-9A-Fa-f]{2}>")
WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Codec:
    """Encodes and decodes batches. Where the model allows it, each distinct word is encoded once and remembered (up to
    MOST_WORDS of them, then the memory starts anew); the results are those of whole texts.

    Ids are bytes of little-endian 32-bit numbers. ok says for each text that the sentencepiece library encodes it (its
    words) alike; back says that decoding the text's ids gives the text again.
    """

    MOST_WORDS = 200_000

    def __init__(self, data: bytes, verify: bool = True):
        import sentencepiece

        self.model = Model(data)
        self.ours = self.model.tokenizer()
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        self.apart = self.model.apart()
        if self.apart:
            from tokenizers import normalizers

            self.core = self.model.tokenizer()
            self.core.normalizer = normalizers.Sequence([])
            self.bytes_of = [bytes([int(p[3:5], 16)]) if BYTE_PIECE.fullmatch(p) else p.replace(MARK, " ").encode() for p, _, _ in self.model.pieces]
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words on which the libraries differ

    def _learn(self, words: list[str]) -> None:
        runs = [words[i : i + 512] for i in range(0, len(words), 512)]
        ids = []
        for run, e in zip(runs, self.core.encode_batch(runs, is_pretokenized=True, add_special_tokens=False)):
            flat, cuts = e.ids, np.searchsorted(np.array(e.word_ids), np.arange(len(run) + 1)).tolist()
            ids += [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        plain = [w[1:].replace(MARK, " ") for w in words]
        if self.theirs:
            right = self.theirs.encode(plain, num_threads=1)
            right = [r if p else [self.theirs.piece_to_id(MARK)] for p, r in zip(plain, right)]
            self.odd.update(w for w, a, b in zip(words, ids, right) if a != b)
        self.known.update((w, np.asarray(i, "<i4").tobytes()) for w, i in zip(words, ids))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """(ids, ok, back) of each text."""
        if not self.apart:
            ids = [e.ids for e in self.ours.encode_batch_fast(texts, add_special_tokens=False)]
            right = self.theirs.encode(texts, num_threads=1) if self.theirs else ids
            out = [np.asarray(i, "<i4").tobytes() for i in ids]
            return out, [a == b for a, b in zip(ids, right)], [a == b for a, b in zip(self.decode(out), texts)]
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > self.MOST_WORDS:
            self.known, self.odd = {}, set()
        if new := list({w for words in split for w in words}.difference(self.known)):
            self._learn(new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        ok = [self.odd.isdisjoint(words) if self.odd else True for words in split]
        return out, ok, [a == b for a, b in zip(self.decode(out), texts)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Whole texts. Where texts are encoded word by word, the bytes of a text's pieces are put together here, as the
        library's decoder does; it is asked itself about bytes that are no text."""
        rows = [np.frombuffer(i, "<i4").tolist() for i in ids]
        if not self.apart:
            return self.ours.decode_batch(rows, skip_special_tokens=False)
        out = []
        for row in rows:
            raw = b"".join(map(self.bytes_of.__getitem__, row))
            try:
                out.append(raw.decode().removeprefix(" "))
            except UnicodeDecodeError:
                out.append(self.ours.decode(row, skip_special_tokens=False))
        return out


@lru_cache(2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _batches(batches, data: bytes, make):
    at = codec(data)
    for b in batches:
        _, offs = utf8(b.column(b.schema.get_field_index("text")))
        for lo, hi in pieces(offs):
            part = b.slice(lo, hi - lo)
            texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield make(part, *at.encode(texts))
    at.known, at.odd = {}, set()  # the worker goes on to other tasks


def digests(spark: SparkSession, docs: DataFrame, path: str = MODEL, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), parity (encoding
    agrees with the sentencepiece library), round_trip (decoding gives the text). Null and empty texts have no ids.
    The model file is read by the driver and sent along, so executors need no copy."""
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read()

    def make(part, ids, ok, back):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(ok, pa.bool_()), pa.array(back, pa.bool_())], [key, "n_tokens", "ids_sha256", "parity", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(lambda batches: _batches(batches, data, make), f"`{key}` {kind}, n_tokens long, ids_sha256 string, parity boolean, round_trip boolean")


def encoded(spark: SparkSession, docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with the columns token_ids (array<int>), n_tokens, parity and round_trip (see digests()) beside their own, which
    they replace if there. Null and empty texts have no ids."""
    small_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    docs = docs.drop("token_ids", "n_tokens", "parity", "round_trip")

    def make(part, ids, ok, back):
        flat = np.frombuffer(b"".join(ids), "<i4")
        offs = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32())), pa.array(np.diff(offs).astype(np.int64)), pa.array(ok, pa.bool_()), pa.array(back, pa.bool_())], [*part.schema.names, "token_ids", "n_tokens", "parity", "round_trip"])

    schema = StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("parity", BooleanType()), StructField("round_trip", BooleanType())])
    return docs.mapInArrow(lambda batches: _batches(batches, data, make), schema)


def decoded(spark: SparkSession, docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs (token_ids, ...) with the decoded text in the column text; null ids decode to null."""
    with open(path, "rb") as f:
        data = f.read()
    docs = docs.drop("text")
    at = docs.columns.index("token_ids")

    def run(batches):
        for b in batches:
            ids = b.column(at).to_pylist()
            texts = codec(data).ours.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], [*b.schema.names, "text"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("text", StringType())]))
