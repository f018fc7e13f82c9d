"""Vectorised text primitives over Arrow batches: words, their hashes, sorted hash arrays.

Batches are taken in slices of some megabytes (one document at least), so a worker's memory follows the longest document and
not the number of rows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


#: Called when a partition ends, to empty what a worker keeps between batches.
FORGET: list[Callable[[], None]] = []


def release() -> None:
    """Give free memory back to the system: Spark keeps workers for later stages, and what they hold adds to the next stage's own."""
    for forget in FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """``run``, a function of a partition's batches, that releases memory at the end of the partition."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _ends(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def _ends(col: pa.Array) -> np.ndarray:
    return np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none) followed by 16 zero bytes, and n + 1 offsets."""
    ends = _ends(col)
    data = b"".join(b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist())
    return np.frombuffer(data + bytes(16), np.uint8), np.concatenate([[0], ends])


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are not ``apart``, and n + 1 offsets of the documents' runs."""
    n = int(offsets[-1])
    inside = ~apart[data[:n]]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cut = offsets[1:-1]
        before[cut[cut < n]] = False
        after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * _M2
        h = (h ^ (h >> U64(27))) * _M3
        return h ^ (h >> U64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes a step. ``data`` ends with 16 spare bytes."""
    left = (ends - starts).astype(np.int64)
    words = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    with np.errstate(over="ignore"):
        h = left.astype(U64) * _M1
        live = slice(None)
        at = starts
        while True:
            x = np.ascontiguousarray(words[at]).view(U64).reshape(-1) & _KEEP[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ x) + _M1)
            more = left > 8
            if not more.any():
                return h
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words inside each document (all of them, if it has fewer but some), and offsets."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(made)])
    if not out_off[-1]:
        return np.zeros(0, U64), out_off
    first = np.repeat(offsets[:-1] - out_off[:-1], made) + np.arange(out_off[-1])
    have = np.minimum(np.repeat(counts, made), width)
    with np.errstate(over="ignore"):
        h = have.astype(U64) * _M3
        for k in range(width):
            x = words[np.minimum(first + k, len(words) - 1)]
            h = np.where(k < have, mix((h ^ x) + _M1), h)
    return h, out_off


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over [offsets[i], offsets[i + 1]), 0 where empty; over the first axis."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


class HashArray:
    """Ascending 64-bit hashes with values beside them; found through the leading bits, without a tree or a dictionary."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 2))))
        self.index = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits)).astype(np.int64)
        widths = np.diff(np.concatenate([self.index, [len(keys)]]))
        self.steps = int(widths.max(initial=0))
        self.padded = np.concatenate([keys, np.full(1, 2**64 - 1, U64)])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether the hash is there (else the place means nothing)."""
        at = self.index[(h >> U64(64 - self.bits)).astype(np.int64)]
        for _ in range(self.steps):
            behind = self.padded[at] < h
            if not behind.any():
                break
            at = at + behind
        return at, (self.padded[at] == h) & (at < len(self.keys))
