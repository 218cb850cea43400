"""Words of Arrow string columns as arrays: offsets and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
CHUNK_BYTES = 2 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on the input's."""
    h = h ^ (h >> np.uint64(31))
    h = h * _K2
    h = h ^ (h >> np.uint64(29))
    h = h * _K1
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of a column: first and last row, their UTF-8 bytes, and the bytes' offsets by text.

    Nulls are empty texts. A chunk has ``limit`` bytes at most, or one text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes unchanged."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` in byte offsets, and the number of the first word of each text (one more entry than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: equal bytes, equal hash."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), buffer=padded, strides=(1,))
    size = ends - starts
    h = mixed((lanes[starts] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _K1))
    rest, at = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - at
        h[rest] = mixed(h[rest] * _K1 ^ (lanes[starts[rest] + at] & _MASK[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    return h


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` consecutive word hashes; empty if there are fewer.

    Doubling: runs of 1, 2, 4, ... words are combined, so the cost grows with log width.
    """
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out, have, run, size = None, 0, h, 1
    n = len(h)
    left = width
    while left:
        if left & 1:
            part = run[have : have + n - width + 1]
            out = mixed(part) if out is None else mixed(out * _K1 ^ part)
            have += size
        left >>= 1
        if left:
            run = mixed(run[:-size] * _K2 ^ run[size:])
            size *= 2
    return out
