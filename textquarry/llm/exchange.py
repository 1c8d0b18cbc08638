"""Questions from groups of documents to blocks of a distributed index, and back.

Documents are dealt to chunks by hash. A chunk sends one row to each block of the key space with
its distinct keys in order; the block, which sees the keys of all chunks, answers row by row. The
chunk then meets its answers in a cogroup with the same shuffle of the documents. So an index of
any size is never held in one place, and equal keys of a chunk travel once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_size(documents: DataFrame) -> int:
    return int(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def dealt(documents: DataFrame, chunk_bytes: int, size: int) -> DataFrame:
    """Adds `chunk`; whole documents, about `chunk_bytes` of text each."""
    chunks = max(1, -(-size // chunk_bytes))
    return documents.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def block_edges(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block's part of the sorted keys begins and ends."""
    width = (1 << 64) // blocks
    cuts = np.array([i * width for i in range(1, blocks)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All rows of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def planes(values: list[np.ndarray]) -> pa.Array:
    """Like `binary`, but byte by byte of all values, so that equal high bytes compress to little."""
    return pa.array([v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() for v in values], pa.binary())


def from_planes(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()
