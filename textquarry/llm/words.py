"""Words of whole texts as arrays of 64-bit hashes, straight from Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of
other code points. Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
FACTOR = 0xD6E8FEB86659FD93  # odd


def give_back() -> None:
    """Return freed memory to the system, so that a worker kept for later tasks doesn't hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by itself
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x + STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: document d has words offsets[d] to offsets[d + 1]."""

    data: np.ndarray  # the bytes, eight more than the texts have
    bounds: np.ndarray  # of the documents within data
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        eights = np.ndarray((len(self.data) - 7,), np.uint64, buffer=self.data.data, strides=(1,))
        length = self.stops - self.starts
        h = mixed(length.astype(np.uint64)) ^ (eights[self.starts] & FIRST_BYTES[np.minimum(length, 8)])
        h = mixed(h)
        at, more = 8, np.flatnonzero(length > 8)
        while len(more):
            part = eights[self.starts[more] + at] & FIRST_BYTES[np.minimum(length[more] - at, 8)]
            h[more] = mixed(h[more] ^ part)
            at += 8
            more = more[length[more] > at]
        return h


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """`data` must be eight bytes longer than the last bound."""
    size = len(data) - 8
    inside = ~SEPARATOR[data[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < size)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Words(data, bounds, np.searchsorted(starts, bounds), starts, np.flatnonzero(ends) + 1)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.chunked_array([c.cast(pa.large_string()) for c in column.chunks], pa.large_string()).combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data, bounds


def parts(column: pa.Array | pa.ChunkedArray, lower: bool = False, most: int = 2 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of rows of about `most` bytes, whole texts only."""
    data, bounds = text_bytes(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        size = int(bounds[until] - bounds[row])
        piece = np.zeros(size + 8, np.uint8)
        piece[:size] = data[bounds[row] : bounds[until]]
        yield row, until, find_words(LOWER[piece] if lower else piece, bounds[row : until + 1] - bounds[row])
        row = until


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, by doubling."""

    def fold(n: int) -> np.ndarray:
        if n == 1:
            return h
        half = n // 2
        short = fold(half)
        joined = short[:-half] * np.uint64(pow(FACTOR, half, 1 << 64)) + short[half:]
        return joined if n % 2 == 0 else joined[:-1] * np.uint64(FACTOR) + h[n - 1 :]

    return mixed(fold(n)) if len(h) >= n else np.empty(0, np.uint64)


def whole_windows(words: Words, n: int) -> np.ndarray:
    """Positions at which n consecutive words of one document begin."""
    left = np.repeat(words.offsets[1:], words.counts) - np.arange(words.offsets[-1])
    return np.flatnonzero(left >= n)
