"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token pieces of at most `capacity`; pieces are dealt to regions by hash, and each
region is evolved by several islands, one task each. An individual is a list of bins. Crossover
injects well-filled bins of one parent whole into the other, drops the bins that hold the same
pieces, and best-fits the displaced pieces, longest first. After each epoch every island's elite
moves to the next island of its region. An island stops when its best has as few bins as the
lengths allow, so most work is done only where best fit alone is not enough.

Defined results: null or empty text is one piece that holds the end id alone; repeated rows are
separate pieces; a null doc_id stays null; an empty table gives an empty result; extra columns are
ignored. Given the same rows, seed and region size, the packing is the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.tokens import drop_encoders, encoder
from textquarry.llm.words import give_back
from textquarry.session import cut_lineage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int, end_id: int, remember_bytes: int, keep: bool, most: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, remember_bytes)
        for batch in batches:
            texts, row = batch.column("text"), 0
            while row < len(texts):
                some, size, first = [], 0, row
                while row < len(texts) and (not some or size < most):
                    some.append(texts[row].as_py() or "")
                    size += len(some[-1])
                    row += 1
                ids, bounds = known.encode(some)
                yield _cut(batch.column("doc_id").slice(first, row - first), ids, bounds, capacity, end_id)
        if not keep:
            del known
            drop_encoders()
        give_back()

    return run


def _cut(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, end_id: int) -> pa.RecordBatch:
    """The pieces of some documents; a document longer than a sequence begins with its shorter piece."""
    rows, piece, start, length, crc = [], [], [], [], []
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
        first = len(whole) % capacity or capacity
        edges = [0, *range(first, len(whole) + 1, capacity)]
        for i, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
            rows.append(d)
            piece.append(i)
            start.append(x)
            length.append(y - x)
            crc.append(zlib.crc32(whole[x:y].tobytes()))
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def token_pieces(
    documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remember_bytes: int = 128 << 20, keep: bool = True
) -> DataFrame:
    """The token pieces of every document (doc_id, text).

    A worker remembers cuts up to `remember_bytes`. Without `keep` it drops its encoder after each
    task, for jobs whose other steps run in the same workers.
    """
    return documents.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id, remember_bytes, keep), PIECES)


Bins = list[list[int]]


def best_fit(bins: Bins, fills: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Puts each item into the fullest bin that has room, else into a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room for exactly r more
    for i, fill in enumerate(fills):
        by_room[capacity - fill].append(i)
        rooms |= 1 << (capacity - fill)
    for item in items:
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[i].append(item)
            fills[i] += size
        else:
            i, room = len(bins), capacity
            bins.append([item])
            fills.append(size)
        by_room[room - size].append(i)
        rooms |= 1 << (room - size)


def fitness(fills: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, fuller ones."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills)


def crossover(giver: tuple, taker: tuple, lengths: list[int], capacity: int, rng: np.random.Generator) -> tuple[Bins, list[int]]:
    """A child of `taker` with whole well-filled bins of `giver`."""
    bins, fills = giver
    fullest = np.argsort(-np.array(fills), kind="stable")[: max(1, len(fills) // 2)]
    chosen = [int(i) for i in fullest[rng.random(len(fullest)) < 0.5]]
    child, child_fills = [list(bins[i]) for i in chosen], [fills[i] for i in chosen]
    injected = {item for i in chosen for item in bins[i]}
    displaced = []
    for own, fill in zip(*taker):
        if injected.isdisjoint(own):
            child.append(list(own))
            child_fills.append(fill)
        else:
            displaced += [item for item in own if item not in injected]
    displaced.sort(key=lambda item: -lengths[item])
    best_fit(child, child_fills, displaced, lengths, capacity)
    return child, child_fills


def decoded(labels: np.ndarray, lengths: list[int]) -> tuple[Bins, list[int]]:
    bins: Bins = [[] for _ in range(int(labels.max()) + 1 if len(labels) else 0)]
    for item, label in enumerate(labels.tolist()):
        bins[label].append(item)
    return bins, [sum(lengths[i] for i in b) for b in bins]


def encoded(bins: Bins, count: int) -> np.ndarray:
    labels = np.zeros(count, np.int32)
    for label, own in enumerate(bins):
        labels[own] = label
    return labels


def evolve(lengths: list[int], capacity: int, elites: list[np.ndarray], rng: np.random.Generator, population: int, generations: int):
    """The best individual of one island after some generations."""
    fewest = -(-sum(lengths) // capacity)
    people = [decoded(e, lengths) for e in elites]
    sizes = np.array(lengths)
    while len(people) < population:
        noise = rng.normal(0, 0.05, len(lengths)) if people else np.zeros(len(lengths))
        bins, fills = [], []
        best_fit(bins, fills, np.argsort(-sizes * (1 + noise), kind="stable").tolist(), lengths, capacity)
        people.append((bins, fills))
        if len(fills) == fewest:
            return people[-1]
    rank = lambda p: fitness(p[1], capacity)
    for _ in range(generations):
        people.sort(key=rank, reverse=True)
        if len(people[0][1]) == fewest:
            break
        children = []
        for i in range(population // 2):
            a, b = rng.choice(population, 2, replace=False)
            children += [crossover(people[a], people[b], lengths, capacity, rng), crossover(people[b], people[i], lengths, capacity, rng)]
        people = sorted(people + children, key=rank, reverse=True)[:population]
    return max(people, key=rank)


ELITES = "region int, island int, labels binary"


def _ordered(items: pa.Table) -> pa.Table:
    return items.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length", "ids_crc32")])


def _first_epoch(capacity: int, *args: int):
    return lambda items: _island(capacity, 0, *args)(items, None)


def _island(capacity: int, epoch: int, population: int, generations: int, seed: int):
    def run(items: pa.Table, elites: pa.Table | None) -> pa.Table:
        kinds = [("region", pa.int32()), ("island", pa.int32()), ("labels", pa.binary())]
        if not items.num_rows:
            return pa.table([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
        region, island = items["region"][0].as_py(), items["island"][0].as_py()
        known = sorted(set(elites["labels"].to_pylist())) if elites is not None else []
        lengths = _ordered(items)["length"].to_pylist()
        rng = np.random.default_rng([seed, region, island, epoch])
        best = evolve(lengths, capacity, [np.frombuffer(e, np.int32) for e in known], rng, population, generations)
        row = [region, island, encoded(best[0], len(lengths)).tobytes()]
        return pa.table([pa.array([v], t) for v, (_, t) in zip(row, kinds)], names=[n for n, _ in kinds])

    return run


PACKED = PIECES + ", sequence_id bigint, offset bigint"


def _choose(capacity: int):
    """The best elite of a region, as the place of each piece."""

    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        ordered = _ordered(items)
        lengths = ordered["length"].to_pylist()
        people = [decoded(np.frombuffer(e, np.int32), lengths) for e in sorted(elites["labels"].to_pylist())]
        bins, _ = max(people, key=lambda p: fitness(p[1], capacity)) if people else ([], [])
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for label, own in enumerate(bins):
            at = 0
            for item in own:
                sequence[item], offset[item] = label, at
                at += lengths[item]
        region = items["region"][0].as_py() if items.num_rows else 0
        columns = [ordered[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        names = [f.split()[0] for f in PACKED.split(", ")]
        return pa.table([*columns, pa.array(sequence + (region << 32)), pa.array(offset)], names=names)

    return run


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    region_pieces: int = 8192,
    islands: int = 2,
    epochs: int = 2,
    population: int = 4,
    generations: int = 3,
    seed: int = 5,
) -> DataFrame:
    """Adds sequence_id and offset to every piece."""
    pieces = cut_lineage(pieces)
    regions = max(1, -(-pieces.count() // region_pieces))
    own = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(regions)).cast("int")
    items = pieces.withColumn("region", own)
    spread = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    args = (population, generations, seed)
    elites = cut_lineage(spread.groupBy("region", "island").applyInArrow(_first_epoch(capacity, *args), ELITES))
    for epoch in range(1, epochs):
        arrived = elites.withColumn("island", (F.col("island") + 1) % islands)
        both = elites.unionByName(arrived)
        evolved = spread.groupBy("region", "island").cogroup(both.groupBy("region", "island"))
        elites = cut_lineage(evolved.applyInArrow(_island(capacity, epoch, *args), ELITES))
    return items.groupBy("region").cogroup(elites.groupBy("region")).applyInArrow(_choose(capacity), PACKED)
