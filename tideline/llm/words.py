"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; none of them occurs inside a
UTF-8 sequence. Texts are handled in slices of about a megabyte, a longer text alone,
whole. Null texts are empty.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SMALL_BYTES = 1 << 18  # where the work on a slice takes a hundred times its bytes, which a worker keeps
_BASE = 0x9E3779B97F4A7C55  # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def worker_cache(name: str, build: Callable):
    """What ``build`` returned the first time in this Python process.

    Functions travel by value, so a module's own globals do not outlive a task.
    """
    store = sys.modules.setdefault("tideline_worker_cache", types.ModuleType("tideline_worker_cache"))
    if not hasattr(store, name):
        setattr(store, name, build())
    return getattr(store, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = np.asarray(x).astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by the process."""
    have = worker_cache(name, lambda: np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        setattr(sys.modules["tideline_worker_cache"], name, have)
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, equal for equal runs wherever they lie."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n, "powers"), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(_INVERSE, n + 1, "inverses")[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def as_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls become empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def as_text(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The inverse of :func:`as_buffers`, as strings unless another type is named."""
    big = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return big.cast(kind or pa.string())


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within the bytes) of runs of whole texts."""
    data, at = as_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


@dataclass
class Words:
    """Words of a slice: byte bounds, the row each lies in, and each row's first word (one more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return run_hashes(table[self.data], self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each run of k words of one row; with ``short``, a row of fewer counts whole."""
        n = len(hashes)
        begin = np.arange(n)
        stop = begin + k
        last = self.first[1:][self.row] if n else begin
        fits = stop <= last
        if short:
            lone = (self.first[:-1][self.row] == begin) & (last - begin < k) if n else fits
            stop, fits = np.where(lone, last, stop), fits | lone
        begin, stop = begin[fits], stop[fits]
        return run_hashes(hashes, begin, stop), begin


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts between ``offsets``; ``lower`` makes A-Z lower case."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    is_space = np.zeros(256, bool)
    is_space[[32, 9, 10, 11, 12, 13]] = True
    solid = ~is_space[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """source[start:start + length] of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return source[:0]
    ends = np.cumsum(lengths)
    return source[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values between consecutive bounds, ascending, and the new bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1], bounds[1:]):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds, modulo 2**64 for unsigned values."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of values between consecutive bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def longs(values: np.ndarray) -> pa.Array:
    """64-bit values as Spark longs, bit for bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
