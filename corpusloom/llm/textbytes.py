"""Vectorised word and n-gram hashes over Arrow text columns.

Everything here runs inside one Arrow batch of a Spark task and works on the
UTF-8 bytes of the whole batch at once, so a text never becomes Python objects.
A null text counts as empty.  Hashes are 64-bit and stable between runs,
machines and batch borders: they depend on the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A batch is worked on in slices of about this many bytes (a longer text is one slice).
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _class_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
NON_SPACE = _class_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = _class_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on every other; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        full = np.full(size, base, np.uint64)
        full[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(full)
    return have[:n]


class RunHashes:
    """Polynomial hashes of values[start:end] for any pairs, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.sums = np.empty(len(values) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * _powers(_BASE, len(values)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _powers(_BASE_INVERSE, len(self.sums))[starts])


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RunHashes(values)(starts, ends) if len(starts) else np.empty(0, np.uint64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets): text i is data[offsets[i]:offsets[i + 1]]; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of each part take about `most` bytes."""
    _, offsets = bytes_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """The words of a slice: byte ranges, hashes, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all runs of k words that lie within one text."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))
        at = np.flatnonzero(left >= k)
        return at, run_hashes(self.hashes, at, at + k)

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return run_hashes(self.hashes, starts, ends)


def words_of(column: pa.Array, table: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    data, offsets = bytes_of(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    some = np.flatnonzero(np.diff(offsets) > 0)
    begins[offsets[some]] = inside[offsets[some]]
    stops[offsets[some + 1] - 1] = inside[offsets[some + 1] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    hashes = run_hashes(BYTE_CODES[data], starts, ends) if n else np.empty(0, np.uint64)
    return Words(data, offsets, starts, ends, first, hashes)


def covered(starts: np.ndarray, length, n: int) -> np.ndarray:
    """Marks which of n places lie in [s, s + length) for any s."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
