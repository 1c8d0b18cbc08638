"""Deduplication of long lines that many documents share.

The key of a line is the line without white space at its ends, A-Z in lower case. A key of at least
`least_chars` code points that at least `least_documents` documents hold loses its lines in all of
them but the one with the largest doc_id.

No line is ever joined to a line. Every distinct key is a 128-bit hash; equal hashes are counted by
a grouped aggregation, combined before the shuffle. Shards of the hash space then index their keys
by a minimal perfect hash (cascading bit arrays, some three bits a key) over compact arrays: a
fingerprint, a count that stops at 255, and the largest doc_id. A chunk of documents sends each
shard its distinct keys once and is told which of them are frequent, and where they stay. A
message holds at least one key, so messages never outnumber lines.

Defined results: each row is a document, also when doc_ids repeat, and rows that share the largest
doc_id all keep their lines; a null doc_id is less than all others; a null or empty text is one
empty line; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import exchange
from textquarry.llm.words import LOWER, SEPARATOR, STEP, mixed, text_bytes

KEY = np.dtype([("high", "<u8"), ("low", "<u8")])
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id
MOST_COUNTED = 255


# Lines of a run of texts


@dataclass
class Lines:
    """Lines of some texts: text t has lines offsets[t] to offsets[t + 1]."""

    offsets: np.ndarray
    long: np.ndarray  # the lines whose key is long enough, in order
    keys: np.ndarray  # of the long lines

    def rows(self) -> np.ndarray:
        """The text of each long line."""
        return np.searchsorted(self.offsets, self.long, "right") - 1


def find_lines(data: np.ndarray, bounds: np.ndarray, least_chars: int) -> Lines:
    """`bounds` begin at 0 and end with `data`."""
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, bounds)) + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    starts, stops = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.int64)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[:-1]] = False
    starts[offsets[:-1]], starts[inner] = bounds[:-1], breaks + 1
    inner[:] = True
    inner[offsets[1:] - 1] = False
    stops[offsets[1:] - 1], stops[inner] = bounds[1:], breaks
    solid = np.flatnonzero(~SEPARATOR[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, stops)
    filled = np.flatnonzero(high > low)
    starts, stops = solid[low[filled]], solid[high[filled] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = chars[stops] - chars[starts] >= least_chars
    lowered = LOWER[data].tobytes()
    hashed = (xxhash.xxh3_128_digest(lowered[a:b]) for a, b in zip(starts[long].tolist(), stops[long].tolist()))
    return Lines(offsets, filled[long], np.frombuffer(b"".join(hashed), KEY))


def runs(column: pa.ChunkedArray, least_chars: int, most: int = 4 << 20) -> Iterator[tuple[int, int, Lines]]:
    """(first row, row after the last, lines) of runs of whole texts of about `most` bytes."""
    data, bounds = text_bytes(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        until = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, until, find_lines(data[bounds[row] : bounds[until]], bounds[row : until + 1] - bounds[row], least_chars)
        row = until


def _in_order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort((keys["low"], keys["high"]))


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where ordered keys differ from the one before."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys["high"][1:] != keys["high"][:-1]) | (keys["low"][1:] != keys["low"][:-1])
    return new


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = keys[_in_order(keys)]
    return keys[_changes(keys)]


def _find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each key among distinct ordered keys, or -1."""
    found = np.full(len(keys), -1, np.int64)
    at, end = (np.searchsorted(among["high"], keys["high"], side) for side in ("left", "right"))
    left = np.flatnonzero(at < end)
    while len(left):  # once, but for keys that share their high half
        hit = among["low"][at[left]] == keys["low"][left]
        found[left[hit]] = at[left[hit]]
        at[left] += 1
        left = left[~hit & (at[left] < end[left])]
    return found


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


# The minimal perfect hash


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seeded = mixed(keys["low"] + np.uint64((2 * level + 1) * int(STEP) % (1 << 64)))
    return (mixed(keys["high"] ^ seeded) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys.

    A key's number is the rank of its bit: at the first level where no other key falls on the same
    bit. Keys that meet others go on to the next, smaller level.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes = sizes
        self.bits = bits
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        sizes, parts = [], []
        while len(keys):
            size = -(-max(int(room * len(keys)), 64) // 8) * 8
            at = _places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of one that was not indexed any number, or -1."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            bit = self.first[level] + _places(keys[left], level, size)
            byte, mask = self.bits[bit >> 3], (1 << (bit & 7)).astype(np.uint8)
            hit = (byte & mask) != 0
            found[left[hit]] = self.ranks[bit[hit] >> 3] + np.bitwise_count(byte[hit] & (mask[hit] - np.uint8(1)))
            left = left[~hit]
        return found


INDEX = "shard int, n bigint, sizes array<bigint>, bits binary, fingerprints binary, counts binary, holders binary"


def _indexed(counted: pa.Table) -> pa.Table:
    """The compact arrays of one shard."""
    keys = np.empty(len(counted), KEY)
    keys["high"], keys["low"] = (counted[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("high", "low"))
    hashed = PerfectHash.build(keys)
    at = hashed.numbers(keys)
    prints, counts, holders = np.empty(len(keys), "<u4"), np.empty(len(keys), np.uint8), np.empty(len(keys), "<i8")
    prints[at] = _fingerprints(keys)
    counts[at] = np.minimum(counted["documents"].to_numpy(), MOST_COUNTED)
    holders[at] = _ids(counted["holder"])
    row = {
        "shard": [counted["shard"][0].as_py()],
        "n": [len(keys)],
        "sizes": [hashed.sizes],
        "bits": [hashed.bits.tobytes()],
        "fingerprints": [prints.tobytes()],
        "counts": [counts.tobytes()],
        "holders": [holders.tobytes()],
    }
    kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
    return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(row.items(), kinds)})


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (keys["low"] >> np.uint64(32)).astype("<u4")


class Shard:
    """A row of the index, ready to be asked."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint8))
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.counts = np.frombuffer(row["counts"], np.uint8)
        self.holders = np.frombuffer(row["holders"], "<i8")

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each key (at most 255) and the largest doc_id; 0 for unknown keys."""
        at = self.hash.numbers(keys)
        known = (at >= 0) & (self.prints[at] == _fingerprints(keys))
        return np.where(known, self.counts[at], 0), np.where(known, self.holders[at], NO_ID)


# The Spark plan


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys["high"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _counted(least_chars: int, shards: int):
    """For each run of texts its distinct keys: how many rows hold one, and the largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch["doc_id"])
            for first, _, lines in runs(batch["text"], least_chars):
                rows = lines.rows()
                order = np.lexsort((rows, lines.keys["low"], lines.keys["high"]))
                keys, rows = lines.keys[order], rows[order]
                new_key = _changes(keys)
                new = new_key.copy()
                new[1:] |= rows[1:] != rows[:-1]
                at = np.flatnonzero(new_key)
                documents = np.add.reduceat(new, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
                holder = np.maximum.reduceat(ids[rows + first], at) if len(at) else np.zeros(0, np.int64)
                keys = keys[at]
                columns = [
                    pa.array(shard_of(keys, shards).astype(np.int32)),
                    pa.array(np.ascontiguousarray(keys["high"]).view(np.int64)),
                    pa.array(np.ascontiguousarray(keys["low"]).view(np.int64)),
                    pa.array(documents),
                    pa.array(holder, pa.int64(), mask=holder == NO_ID),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "high", "low", "documents", "holder"])

    return run


def line_index(documents: DataFrame, least_chars: int = 40, shards: int = 64) -> DataFrame:
    """The compact arrays over all long lines of the documents, a row for each shard."""
    kind = "shard int, high bigint, low bigint, documents bigint, holder bigint"
    seen = documents.select("doc_id", "text").mapInArrow(_counted(least_chars, shards), kind)
    counted = seen.groupBy("shard", "high", "low").agg(F.sum("documents").alias("documents"), F.max("holder").alias("holder"))
    return counted.groupBy("shard").applyInArrow(_indexed, INDEX)


def _asked(least_chars: int, shards: int):
    """A message to each shard with the distinct keys of a chunk."""

    def run(docs: pa.Table) -> pa.Table:
        keys = [_distinct(lines.keys) for _, _, lines in runs(docs["text"], least_chars)]
        keys = _distinct(np.concatenate([np.zeros(0, KEY), *keys]))
        edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
        sent = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
        return pa.table(
            {
                "chunk": pa.array([docs["chunk"][0].as_py()] * len(sent), pa.int32()),
                "shard": pa.array([s for s, _, _ in sent], pa.int32()),
                "keys": exchange.binary([keys[a:b] for _, a, b in sent]),
            }
        )

    return run


def _answered(least_documents: int):
    """To each chunk its frequent keys, and the documents that keep them."""

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        shard = Shard(index.to_pylist()[0]) if len(index) else None
        out = []
        for chunk, sent in zip(asked["chunk"].to_pylist(), asked["keys"].to_pylist()):
            keys = np.frombuffer(sent, KEY)
            counts, holders = shard.probe(keys)
            frequent = (counts >= least_documents) & (holders != NO_ID)
            if frequent.any():
                out.append((chunk, keys[frequent].tobytes(), holders[frequent].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, kinds)]
        return pa.Table.from_arrays(columns, names=["chunk", "keys", "holders"])

    return run


def _cut(least_chars: int):
    """The documents of a chunk without the lines that stay elsewhere."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, holders = exchange.joined(answers["keys"], KEY), exchange.joined(answers["holders"], "<i8")
        order = _in_order(keys)
        keys, holders = keys[order], holders[order]
        ids, texts = _ids(docs["doc_id"]), docs["text"]
        n_lines, n_dropped, kept = [], [], []
        for first, until, lines in runs(texts, least_chars):
            at = _find(lines.keys, keys)
            asked = np.flatnonzero(at >= 0)
            dropped = lines.long[asked[ids[lines.rows()[asked] + first] != holders[at[asked]]]]
            edges = np.searchsorted(dropped, lines.offsets)
            n_lines.append(np.diff(lines.offsets))
            n_dropped.append(np.diff(edges))
            for row in range(until - first):
                text = texts[first + row].as_py() or ""
                if edges[row] < edges[row + 1]:
                    out = set((dropped[edges[row] : edges[row + 1]] - lines.offsets[row]).tolist())
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)
                kept.append(text)
        columns = [docs["doc_id"].combine_chunks(), *(pa.array(np.concatenate(c).astype(np.int64)) for c in (n_lines, n_dropped)), pa.array(kept, pa.string())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def drop_frequent_lines(
    documents: DataFrame,
    least_chars: int = 40,
    least_documents: int = 5,
    shard_bytes: int = 64 << 20,
    chunk_bytes: tuple[int, int] = (1 << 20, 16 << 20),
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text) of all documents (doc_id, text).

    A shard indexes the lines of about `shard_bytes` of text, a chunk holds a 256th of the text
    within the bounds of `chunk_bytes`.
    """
    if not 0 < least_documents <= MOST_COUNTED:
        raise ValueError(f"least_documents must be between 1 and {MOST_COUNTED}")
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = exchange.text_size(documents)
    shards = max(64, -(-size // shard_bytes))
    chunk = min(max(chunk_bytes[0], size // 256), chunk_bytes[1])
    index = line_index(documents, least_chars, shards)
    texts = exchange.dealt(documents, chunk, size)
    asked = texts.groupBy("chunk").applyInArrow(_asked(least_chars, shards), "chunk int, shard int, keys binary")
    answers = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(
        _answered(least_documents), "chunk int, keys binary, holders binary"
    )
    kind = "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(least_chars), kind)
