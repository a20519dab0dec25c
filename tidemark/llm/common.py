"""Shared helpers: reading, bounded broadcast joins and Arrow batch slicing; staging comes from the library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.staging import drop_stage, stage

__all__ = ["BROADCAST_ROWS", "SPACES", "SPACE_CLASS", "drop_stage", "lookup_join", "pieces", "read", "small_batches", "stage", "utf8"]

#: The separators of words in every contract: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that a batch of long texts stays in memory. The session keeps the setting;
    a smaller one of the caller stands."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Rows that lookup_join() sends to every executor at most.
BROADCAST_ROWS = 200_000


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a table of a few columns per key. Up to BROADCAST_ROWS rows (counted) are broadcast; a larger table is
    joined by a shuffle in which adaptive execution splits hot keys."""
    n = small.limit(BROADCAST_ROWS + 1).count()
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, keys, how)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges (lo, hi) of about most bytes each; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
