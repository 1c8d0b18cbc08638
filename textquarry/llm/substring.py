"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored from left to right against the indexed reference blocks, which hold
the earliest place of each repeated window of `window` words in the corpus. A factor begins where
a window starts earlier (smaller doc_id, or the same document, earlier start), runs as long as the
reference goes on, and ends at the last word the reference covers; the windows at the boundary of
two factors are looked up like all others, so a repeat that straddles it is found too. Every
factor has at least `window` words and becomes a duplicate span.

Reference blocks are filled in two steps, so that unrepeated text hardly travels. First only the
minimizers of the windows (the least hash of their shorter word runs, the same in equal windows)
are counted. Then the windows whose minimizer occurs twice are indexed with their earliest place.

Defined results: null, empty and short texts have no window and keep all words; a null doc_id
comes after all others; rows that repeat a doc_id are one document, whose places are compared by
start only; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm import exchange
from textquarry.llm.words import Words, give_back, parts, sequences, whole_windows

LAST = np.iinfo(np.int64).max  # stands for a null doc_id


def _sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= n:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return np.minimum(least[: len(values) - n + 1], least[n - span :]) if span < n else least


class Windows:
    """The windows of a chunk's documents: hash, place and minimizer, in the order of the rows."""

    def __init__(self, docs: pa.Table, window: int, minimizers: bool):
        ids = np.array([LAST if d is None else d for d in docs["doc_id"].to_pylist()], np.int64)
        short = (window + 1) // 2
        keys, rows, starts, least, picked = [], [], [], [], []
        self.words: list[tuple[int, Words]] = []
        for first, _, words in parts(docs["text"]):
            self.words.append((first, words))
            h = words.hashes()
            at = whole_windows(words, window)
            if not len(at):
                continue
            row = words.documents()[at]
            keys.append(sequences(h, window)[at])
            rows.append(row + first)
            starts.append(at - words.offsets[row])
            if minimizers:
                runs = sequences(h, short)
                lows = _sliding_least(runs, window - short + 1)[at]
                least.append(lows)
                chosen = np.zeros(len(runs), bool)
                for back in range(window - short + 1):
                    chosen[at + back] |= runs[at + back] == lows
                picked.append(runs[chosen])
        whole = lambda some, kind: np.concatenate(some) if some else np.zeros(0, kind)
        self.keys, self.rows, self.starts = whole(keys, np.uint64), whole(rows, np.int64), whole(starts, np.int64)
        self.ids = ids[self.rows]
        if minimizers:
            self.least = whole(least, np.uint64)
            self.minimizers, self.minimizer_counts = np.unique(whole(picked, np.uint64), return_counts=True)


def _row_table(chunk: int, edges: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each block that has keys."""
    spans = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(spans), pa.int32()),
            "block": pa.array([b for b, _, _ in spans], pa.int32()),
            **{name: exchange.binary([values[x:y] for _, x, y in spans]) for name, values in columns.items()},
        }
    )


def _released(run):
    """The function of a group or of two, which leaves their memory to others when it ends."""

    def one(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            give_back()

    def two(rows: pa.Table, answers: pa.Table) -> pa.Table:
        try:
            return run(rows, answers)
        finally:
            give_back()

    return two if run.__code__.co_argcount == 2 else one


def _ask_minimizers(window: int, blocks: int):
    def run(docs: pa.Table) -> pa.Table:
        w = Windows(docs, window, minimizers=True)
        edges = exchange.block_edges(w.minimizers, blocks)
        return _row_table(docs["chunk"][0].as_py(), edges, keys=w.minimizers, twice=w.minimizer_counts > 1)

    return run


def _repeated_minimizers(asked: pa.Table) -> pa.Table:
    """To each chunk, which of its minimizers occur twice or more in the corpus."""
    keys, twice = exchange.joined(asked["keys"], np.uint64), exchange.joined(asked["twice"], bool)
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    total = np.bincount(place, weights=1.0 + twice, minlength=len(count))
    sizes = np.array([len(t) for t in asked["twice"].to_pylist()])
    return pa.table(
        {"chunk": asked["chunk"], "block": asked["block"], "repeated": exchange.binary(np.split((total > 1)[place], np.cumsum(sizes)[:-1]))}
    )


def _first_places(keys: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of each distinct key's earliest place, by ascending key."""
    order = np.lexsort((starts, ids, keys))
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order[new]


def _ask_windows(window: int, blocks: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = _row_table(0, np.zeros(blocks + 1, np.int64), keys=np.zeros(0), ids=np.zeros(0), starts=np.zeros(0))
        if not docs.num_rows or not answers.num_rows:
            return empty
        w = Windows(docs, window, minimizers=True)
        repeated = exchange.joined(answers.sort_by("block")["repeated"], bool)
        asked = np.flatnonzero(repeated[np.searchsorted(w.minimizers, w.least)])
        first = asked[_first_places(w.keys[asked], w.ids[asked], w.starts[asked])]
        edges = exchange.block_edges(w.keys[first], blocks)
        return _row_table(docs["chunk"][0].as_py(), edges, keys=w.keys[first], ids=w.ids[first], starts=w.starts[first].astype(np.int32))

    return run


def _earliest(asked: pa.Table) -> pa.Table:
    """To each chunk, those of its windows that start earlier elsewhere, with that place."""
    keys, ids, starts = (exchange.joined(asked[c], t) for c, t in (("keys", np.uint64), ("ids", np.int64), ("starts", np.int32)))
    first = _first_places(keys, ids, starts)
    place = first[np.searchsorted(keys[first], keys)]
    later = (ids > ids[place]) | ((ids == ids[place]) & (starts > starts[place]))
    cuts = np.cumsum([len(k) // 8 for k in asked["keys"].to_pylist()])[:-1]
    some = [np.flatnonzero(part) + low for part, low in zip(np.split(later, cuts), [0, *cuts])]
    return pa.table(
        {
            "chunk": asked["chunk"],
            "block": asked["block"],
            "keys": exchange.binary([keys[s] for s in some]),
            "ids": exchange.binary([ids[place[s]] for s in some]),
            "starts": exchange.binary([starts[place[s]] for s in some]),
        }
    )


FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("reference_id", pa.int64()), ("reference_start", pa.int64())])
PARSED = (
    "doc_id bigint, n_words bigint, n_removed bigint, kept string, "
    "factors array<struct<start: bigint, length: bigint, reference_id: bigint, reference_start: bigint>>"
)


def _factors(w: Windows, answers: pa.Table, window: int, documents: int) -> tuple[np.ndarray, ...]:
    """(row, start, length, reference id, reference start) of the factors, in row order."""
    first = _first_places(w.keys, w.ids, w.starts)
    ids, starts = w.ids[first].copy(), w.starts[first].copy()
    if answers.num_rows:
        answers = answers.sort_by("block")
        keys = exchange.joined(answers["keys"], np.uint64)
        at = np.searchsorted(w.keys[first], keys)
        ids[at], starts[at] = exchange.joined(answers["ids"], np.int64), exchange.joined(answers["starts"], np.int32)
    place = np.searchsorted(w.keys[first], w.keys)
    ids, starts = ids[place], starts[place]
    repeat = np.flatnonzero((ids < w.ids) | ((ids == w.ids) & (starts < w.starts)))
    row, start, ref, ref_start = w.rows[repeat], w.starts[repeat], ids[repeat], starts[repeat]
    goes_on = (np.diff(row) == 0) & (np.diff(start) == 1) & (np.diff(ref) == 0) & (np.diff(ref_start) == 1)
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(repeat) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(heads, len(repeat))) + window - 1
    return row[heads], start[heads], lengths, ref[heads], ref_start[heads]


def _parse(window: int, carry: tuple[str, ...]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        w = Windows(docs, window, minimizers=False)
        row, start, length, ref, ref_start = _factors(w, answers, window, docs.num_rows)
        n_words, n_removed, texts = [], [], []
        for first, words in w.words:
            counts = words.counts
            here = slice(*np.searchsorted(row, [first, first + len(counts)]))
            begin = words.offsets[row[here] - first] + start[here]
            covered = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + length[here], -1)
            keep = np.cumsum(covered[:-1]) == 0
            removed = np.concatenate([[0], np.cumsum(~keep)])[words.offsets]
            n_words.append(counts)
            n_removed.append(np.diff(removed))
            data, bounds, flags = words.data.tobytes(), words.bounds.tolist(), keep.tolist()
            for d, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist())):
                found = data[bounds[d] : bounds[d + 1]].split()
                texts.append(b" ".join(compress(found, flags[a:b]) if n_removed[-1][d] else found))
        offsets = np.searchsorted(row, np.arange(docs.num_rows + 1)).astype(np.int32)
        null = pa.array(ref, mask=ref == LAST)
        factors = pa.StructArray.from_arrays([pa.array(start), pa.array(length), null, pa.array(ref_start.astype(np.int64))], fields=list(FACTOR))
        column = lambda some: pa.array(np.concatenate(some) if some else np.zeros(0, np.int64), pa.int64())
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": column(n_words),
                "n_removed": column(n_removed),
                "kept": pa.array(texts, pa.binary()).cast(pa.string()),
                "factors": pa.ListArray.from_arrays(offsets, factors),
                **{c: docs[c] for c in carry},
            }
        )

    return run


def remove_repeats(
    documents: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, block_bytes: int = 6 << 20, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Each document (doc_id, text) without the words of its duplicate spans, its factors and the columns to carry.

    A word is dropped if it lies in a window of `window` words that starts earlier in the corpus;
    windows are judged on the input. `kept` joins the other words by one space.
    """
    size = exchange.text_size(documents)
    documents = documents.select("doc_id", "text", *(c for c in carry if c != "text"))
    docs = exchange.dealt(documents, chunk_bytes, size)
    blocks = max(16, -(-size // block_bytes))
    asked = docs.groupBy("chunk").applyInArrow(_released(_ask_minimizers(window, blocks)), "chunk int, block int, keys binary, twice binary")
    repeated = asked.groupBy("block").applyInArrow(_released(_repeated_minimizers), "chunk int, block int, repeated binary")
    placed = "chunk int, block int, keys binary, ids binary, starts binary"
    windows = docs.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_released(_ask_windows(window, blocks)), placed)
    schema = ", ".join([PARSED, *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in carry)])
    earliest = windows.groupBy("block").applyInArrow(_released(_earliest), placed)
    return docs.groupBy("chunk").cogroup(earliest.groupBy("chunk")).applyInArrow(_released(_parse(window, carry)), schema)
