"""Vectorised text kernels: words and their fingerprints over slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: The six white-space bytes that separate words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tidy(run):
    """Gives memory that a task has freed back to the system: workers are used again and would keep it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return go


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), in place of weak low bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and their inverses."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[which] = (both[0], both[1])
        if size > 8 * SLICE_BYTES:  # a huge text: do not keep its tables
            _powers.pop(which)
    return have


def ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """A fingerprint of values[start:end] for each range."""
    up, down = powers(which, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of runs of rows."""
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    off = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    full = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = full[:-1]
    start = np.flatnonzero(full & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = full[1:]
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of every word."""
    if lower:
        data = _LOWER[data]
    return ranges(data.astype(np.uint64) + np.uint64(1), start, end, 0)


def ngrams(words: np.ndarray, k: int, which: int) -> np.ndarray:
    """Fingerprints of the runs of k words that start at each word (rows are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return ranges(words, at, at + k, which)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
