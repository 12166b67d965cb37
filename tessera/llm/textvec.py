"""Vectorised word splitting and hashing over Arrow string batches.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  Those
separators are ASCII, so working on UTF-8 bytes gives the same words as working
on code points.  Texts are processed in blocks of whole documents, so the
working memory follows the block size and the longest document, never the
partition.

Hashes have 64 bits and go over the bytes eight at a time through a mixing
function that isn't linear, so segments of up to eight bytes and equal length never
collide, and longer ones do with a chance of about ``2**-64`` a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 21

#: Segments beyond this many bytes are hashed one by one.
LONG = 64
_STEP = 1 << 16

_U = np.uint64
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SIZE, _LEFT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash for each two, in this order."""
    x = left * _LEFT
    x += right
    return mix(x)


def as_text(column: pa.Array) -> pa.Array:
    """The column as binary with 64-bit offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())


_C = ctypes.CDLL(None)


def give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def lean(run):
    """The function for ``mapInArrow``; when its task ends, the worker, which Spark keeps, gives its free memory back."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


@dataclass
class Block:
    """Rows ``lo..hi`` of a batch: their bytes, and where each row's bytes begin and end."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes."""
    text = as_text(column)
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Word spans in byte offsets, one hash each, and where each row's words begin and end."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _FOLD[data]


def lanes(data: np.ndarray) -> np.ndarray:
    """At every place the eight bytes from there on as one number (zeros follow the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each segment ``start..end``."""
    lane, out = lanes(data), np.empty(len(start), np.uint64)
    for lo in range(0, len(start), _STEP):
        part = slice(lo, lo + _STEP)
        out[part] = _segment_hash(data, lane, start[part], end[part])
    return out


def _segment_hash(data: np.ndarray, lane: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    h = (size + 1).astype(np.uint64) * _SIZE
    h ^= lane[start] & _MASK[np.minimum(size, 8)]
    h = mix(h)
    rest, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(rest):
        h[rest] = mix(h[rest] ^ (lane[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    rest = np.flatnonzero(size > LONG)
    if len(rest):
        h[rest] = [xxhash.xxh3_64_intdigest(data[a:z].tobytes()) for a, z in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
    return h


def equal_segments(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a_start`` in ``a`` are those from ``b_start`` in ``b``."""
    x, y = lanes(a), lanes(b)
    out = ((x[a_start] ^ y[b_start]) & _MASK[np.minimum(size, 8)]) == 0
    rest, at = np.flatnonzero(out & (size > 8)), 8
    while len(rest) and at < LONG:
        out[rest] = ((x[a_start[rest] + at] ^ y[b_start[rest] + at]) & _MASK[np.minimum(size[rest] - at, 8)]) == 0
        at += 8
        rest = rest[out[rest] & (size[rest] > at)]
    for i in rest.tolist():
        out[i] = bool((a[a_start[i] : a_start[i] + size[i]] == b[b_start[i] : b_start[i] + size[i]]).all())
    return out


def words(block: Block, lower: bool = False, hashes: bool = True) -> Words:
    """Split a block into words; ``lower`` folds A-Z before hashing."""
    n = len(block.data)
    inside = ~IS_SEP[block.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = block.off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    end += 1
    del inside, first, last
    h = segment_hash(folded(block.data) if lower else block.data, start, end) if hashes and len(start) else np.zeros(len(start), np.uint64)
    return Words(start, end, h, np.searchsorted(start, block.off))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values (ignoring row ends); empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, out, run, size, n = 0, None, h, 1, len(h) - k + 1
    while True:  # joins the hashes of runs of 1, 2, 4 ... values
        if k & size:
            part = run[done : done + n]
            out = part if out is None else join(out, part)
            done += size
        if done == k:
            return mix(out + _U(k))
        run = join(run[: len(run) - size], run[size:])
        size *= 2


def window_starts(off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes where a window of ``k`` words stays in its row, and each row's offsets into them."""
    count = np.maximum(np.diff(off) - k + 1, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    index = np.arange(to[-1]) + np.repeat(off[:-1] - to[:-1], count)
    return index, to
