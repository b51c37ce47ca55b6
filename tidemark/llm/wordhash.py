"""Words and word shingles of whole Arrow batches as 64-bit hashes, in NumPy.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased.  Its hash is a
polynomial over a fixed random table of byte values, finalised by a 64-bit mixer;
a shingle's hash combines its words' hashes with odd constants.  Two different
shingles meet with probability of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most`` bytes: first row, end row, bytes, offsets from 0.

    Null texts have no bytes.  One text is never divided.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


Batches = Iterator[pa.RecordBatch]


def _trim() -> None:
    """Give freed memory back to the system; a worker lives on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``, which leaves no freed memory behind in the worker."""

    @functools.wraps(run)
    def go(batches: Batches) -> Batches:
        yield from run(batches)
        _trim()

    return go


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to about ``rows`` rows, for what is combined within one."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: words' hashes, first bytes, ends, and per row the index of its first word (one more at the end)."""
    n = len(raw)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    low = _LOWER[raw]
    body = ~_SPACE[low]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = ~body[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(body & edge[:n])
    tail = np.ones(n + 1, dtype=bool)
    tail[: n - 1] = ~body[1:]
    tail[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(body & tail[:n]) + 1
    firsts = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts, ends, firsts
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    value = _BYTE[low[body]] * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64)), starts, ends, firsts


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the caller drops those that cross texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out += h[k : k + m] * _ODD[k]
    return mix(out)


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a sequence of words, as ``ngrams`` of its length gives it."""
    return ngrams(h, len(h))
