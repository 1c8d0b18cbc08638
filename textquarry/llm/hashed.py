"""Multinomial models over hashed byte n-grams, fitted on all rows of each group.

A model is a table of counts, groups x 2**bits; its size is set by its parameters. Every task
counts its rows, and the counts are added slice by slice, so no task holds more than its slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm.words import text_bytes

SLICES = 16


def grams(column: pa.Array, n: int, bits: int, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bucket of each n-gram, offsets by row) for runs of rows."""
    data, bounds = text_bytes(column)
    mask, row, rows = np.uint64((1 << (8 * n)) - 1), 0, len(bounds) - 1
    while row < rows:
        until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        own = bounds[row : until + 1] - bounds[row]
        piece = np.zeros(int(own[-1]) + 8, np.uint8)
        piece[: own[-1]] = data[bounds[row] : bounds[until]]
        eights = np.ndarray((len(piece) - 7,), np.uint64, buffer=piece.data, strides=(1,))
        inside = np.ones(int(own[-1]), bool)
        for back in range(1, n):  # an n-gram ends within its text
            last = own[1:] - back
            inside[last[last >= own[:-1]]] = False
        at = np.flatnonzero(inside)
        values = ((eights[: len(inside)] & mask) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
        yield row, until, values[at], np.searchsorted(at, own)
        row = until


def _count(n: int, bits: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((groups, 1 << bits), np.int64)
        for batch in batches:
            group = np.array([-1 if g is None else g for g in batch.column("group").to_pylist()], np.int64)
            for first, until, values, offsets in grams(batch.column("text"), n, bits):
                own = np.repeat(group[first:until], np.diff(offsets))
                for g in np.unique(group[first:until]):
                    if g >= 0:
                        counts[g] += np.bincount(values[own == g], minlength=1 << bits)
        blobs = [zlib.compress(part.tobytes(), 1) for row in counts for part in np.split(row, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], names=["slot", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, blob in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), np.int64)
            sums[slot] = sums[slot] + part if slot in sums else part
    blobs = [s.tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["slot", "counts"])


def fit(rows: DataFrame, groups: int, n: int, bits: int) -> np.ndarray:
    """Counts, groups x buckets, of all rows (group int, text); a null group counts nowhere."""
    schema = "slot int, counts binary"
    added = rows.select("group", "text").mapInArrow(_count(n, bits, groups), schema).repartition("slot").mapInArrow(_add, schema)
    found = {r["slot"]: np.frombuffer(r["counts"], np.int64) for r in added.collect()}
    empty = np.zeros((1 << bits) // SLICES, np.int64)
    return np.concatenate([found.get(i, empty) for i in range(groups * SLICES)]).reshape(groups, 1 << bits)
