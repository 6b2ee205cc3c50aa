"""Vectorised work on the UTF-8 bytes of Arrow string columns, for use inside Spark tasks.

A column is seen as one byte buffer plus document offsets. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D; every span gets a 64-bit hash from prefix sums, so no Python loop runs per word.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64((np.arange(1, 257, dtype=U64) * U64(_MULT)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers; tables of up to two slices are kept."""
    if len(_powers[kind]) >= n:
        return _powers[kind][:n]
    base = np.full(max(n, SLICE_BYTES + 1), U64(_MULT if kind == "up" else _INVERSE))
    base[0] = 1
    table = np.multiply.accumulate(base)
    if n <= 2 * SLICE_BYTES + 1:
        _powers[kind] = table
    return table[:n]


def tidy(work):
    """work(batches), after which the Python worker gives back what it has freed: Spark keeps workers, and later stages need the room."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 4096):
    """(first row, row after the last) of pieces of at most about so many bytes and so many rows; a longer row stands alone."""
    _, off = packed(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        to = min(to, at + rows, n)
        yield at, to
        at = to


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the number of words before it (one entry more than documents)."""
    if not len(buf):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    full = off[1:] > off[:-1]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][full]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, in ascending order; equal bytes have equal hashes, wherever they stand.

    Long buffers are taken piece by piece, so that a very long text costs little more than its words.
    """
    if len(buf) <= 2 * SLICE_BYTES:
        return _span_hashes(buf, starts, ends)
    out, at = np.empty(len(starts), dtype=U64), 0
    while at < len(starts):
        a = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, a + SLICE_BYTES, side="right")))
        out[at:to] = _span_hashes(buf[a : int(ends[to - 1])], starts[at:to] - a, ends[at:to] - a)
        at = to
    return out


def _span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * _power("up", n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", n + 1)[starts]
    return mix64(raw ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column and the word offsets of its rows."""
    buf, off = packed(column)
    if lower:
        buf = LOWER[buf]
    starts, ends, at = words(buf, off)
    return span_hashes(buf, starts, ends), at


def pair_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 2-word shingles of each document, repeats included; a document of one word has that word as its one shingle."""
    n = np.diff(at)
    if not len(h):
        return h, np.zeros(len(at), np.int64)
    two = mix64(h[:-1] * U64(0xC2B2AE3D27D4EB4F) + (h[1:] ^ (h[1:] >> U64(29))) * U64(0x165667B19E3779F9))
    keep = np.ones(len(h), dtype=bool)
    keep[at[1:][n > 0] - 1] = False
    alone = at[:-1][n == 1]
    out = np.append(two, U64(0))
    out[alone] = mix64(h[alone] ^ U64(0x27D4EB2F165667C5))
    keep[alone] = True
    return out[keep], np.concatenate([[0], np.cumsum(np.where(n > 1, n - 1, n))])
