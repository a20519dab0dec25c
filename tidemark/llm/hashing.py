"""Vectorised hashes of words, word shingles and byte ranges.

A range of bytes is hashed in blocks of eight: every block goes through a bijection of 64 bits that mixes all of them
before the next one is added, so that no regular structure of the bytes (as in a sum of powers) carries over into equal
hashes. Sets of shingles are told apart by two such hashes, 128 bits.
"""

from __future__ import annotations

import numpy as np
import xxhash

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
#: How many bytes of each block belong to the range, as masks.
_mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Multipliers of the two hashes of a range.
_odd = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of a range that are hashed block by block, beside the others of a batch; longer ones come one by one.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a little-endian number, zeros behind the end: a view, nothing is copied
    but the bytes once."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the bytes of each range; two lanes are independent of each other. at: blocks(raw), if there already."""
    at = blocks(raw) if at is None else at
    n = end - start
    h = mix(n.astype(np.uint64) * _odd[lane] + np.uint64(lane + 1))
    live = np.flatnonzero((n > 0) & (n <= LONG))
    for k in range(0, LONG, 8):
        if k:
            live = live[n[live] > k]
        if not len(live):
            break
        v = at[start[live] + k]
        rest = n[live] - k
        if rest.min() < 8:
            v = v & _mask[np.minimum(rest, 8)]
        h[live] = mix((h[live] ^ v) * _odd[lane])
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), lane)
    return h


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all rows, words never crossing rows."""
    if lower:
        raw = _lower[raw]
    solid = ~_space[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = solid[cuts]
    a = np.flatnonzero(first)
    b = np.flatnonzero(last) + 1
    return a, b, ranges(raw, a, b)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of hashes of its width-word shingles (lower-cased A-Z), sorted, one after the other, and the
    rows' offsets in it. Fewer words than width: the whole sequence is one shingle; no words: an empty set."""
    n = len(offsets) - 1
    a, _, w = words(raw, offsets, True)
    row = np.searchsorted(offsets, a, "right") - 1  # empty rows share an offset; the last of them holds the word
    count = np.bincount(row, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= width:
        m = len(w) - width + 1
        h = np.zeros(m, np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + m])
        whole = row[:m] == row[width - 1 :]
        h, owner = h[whole], row[:m][whole]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            on = count[few] > k
            short[on] = mix(short[on] * np.uint64(0xD6E8FEB86659FD93) + w[first[few[on]] + k])
        h, owner = np.concatenate([h, short]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64) if len(owner) else np.zeros(n + 1, np.int64)
    h = h.copy()
    for i in range(n):
        h[edge[i] : edge[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[edge]
