"""Inverted-file vector index: cells around centres, short codes of what is left, exact rerank.

Centres and codebooks are fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those with the least
hash of their id, so the same in every run); every vector is then assigned to its cell, whatever
the sample held, and stored with a code of one byte per ``CODE_WIDTH`` dimensions of its residual.
A search reads the cells whose centres are nearest to a query, orders their vectors by code,
and scores the best of them exactly. Cells that the probes don't name are not read; ``probes`` equal
to the number of cells reads all of them, and ``vectors.cosine_top_k`` stays the exact way.

How many cells to probe and how many vectors to score is measured when the model is fitted: the
least numbers that find ``TARGET`` of the nearest ``NEAREST`` within the sample. Vectors that form
clusters need few cells; those without any structure need most, and then the codes alone, a
sixteenth of the vectors in size, are read widely, while few vectors are scored.

A cell is stored as blocks of at most about ``BLOCK_ROWS`` codes, so a cell that holds a large part
of the vectors is spread over tasks. What tasks are handed besides rows is the model: at most
``MOST_CELLS`` centres and 256 entries per codebook.

Defined results: zero vectors lie in the first cell and score null, hence last; null vectors are
not indexed; ties go to the smaller chunk_id; an empty table gives an empty index and no hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators import vectors
from textquarry.session import cut_lineage
from textquarry.sources.sinks import in_folders

SAMPLE_ROWS = 16_384
MOST_CELLS = 1_024
CODE_WIDTH = 4
ENTRIES = 256
BLOCK_ROWS = 4_096
QUERY_ROWS = 256
FOLDERS = 32
#: What the measured numbers have to find on the sample, each of the two for itself.
TARGET = 0.99
NEAREST = 10
TRIED = 256
MODEL = "cells int, dimensions int, centres binary, books binary, probes int, refine int"
MODEL_ROW = ("cells", "dimensions", "centres", "books", "probes", "refine")


@dataclass(frozen=True)
class VectorIndex:
    """``blocks``: folder, repository_id, cell, rows (chunk_id, code); ``model``: one row."""

    blocks: DataFrame
    model: DataFrame


@dataclass(frozen=True)
class _Model:
    centres: np.ndarray
    books: np.ndarray  # part, entry, value

    @classmethod
    def read(cls, row) -> _Model:
        centres = np.frombuffer(bytes(row["centres"]), np.float32).reshape(row["cells"], row["dimensions"])
        return cls(centres, np.frombuffer(bytes(row["books"]), np.float32).reshape(row["dimensions"] // CODE_WIDTH, -1, CODE_WIDTH))

    def assign(self, matrix: np.ndarray) -> np.ndarray:
        return np.argmax(matrix @ self.centres.T, axis=1)

    def encode(self, matrix: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (matrix - self.centres[cell]).reshape(len(matrix), -1, CODE_WIDTH)
        codes = np.empty(rest.shape[:2], np.uint8)
        for part, book in enumerate(self.books):
            codes[:, part] = _nearest(rest[:, part], book)
        return codes


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)


def _means(points: np.ndarray, count: int, assign: Callable, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; a centre without points moves to a random one."""
    count = min(count, len(points))
    centres = points[rng.choice(len(points), count, replace=False)].copy()
    for _ in range(rounds):
        own = assign(points, centres)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, points)
        held = np.bincount(own, minlength=count)
        filled = held > 0
        centres[filled] = sums[filled] / held[filled, None]
        centres[~filled] = points[rng.choice(len(points), int((~filled).sum()))]
    return centres


def _units(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dimensions)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _measured(points: np.ndarray, model: _Model) -> tuple[int, int]:
    """The cells to probe and the factor by which more vectors are scored than wanted, on the sample."""
    count = min(NEAREST, len(points) - 1)
    if count < 1:
        return len(model.centres), 4
    asked = np.arange(min(TRIED, len(points)))
    exact = points[asked] @ points.T
    exact[asked, asked] = -np.inf
    true = np.argpartition(-exact, count - 1, axis=1)[:, :count]
    cell = model.assign(points)
    codes = model.encode(points, cell)
    near = points[asked] @ model.centres.T
    order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)  # the place of each cell for each query
    coded = near[:, cell]
    for part, book in enumerate(model.books):
        coded = coded + (points[asked].reshape(len(asked), -1, CODE_WIDTH)[:, part] @ book.T)[:, codes[:, part]]
    coded[asked, asked] = -np.inf
    place = np.argsort(np.argsort(-coded, axis=1, kind="stable"), axis=1)
    least = lambda ranks: int(np.sort(ranks.ravel())[math.ceil(TARGET * ranks.size) - 1]) + 1
    probes = least(np.take_along_axis(order, cell[true], 1))
    return probes, max(2, math.ceil(least(np.take_along_axis(place, true, 1)) / count))


def _fit(cells: int, dimensions: int, seed: int, rounds: int):
    def run(sample: pa.Table) -> pa.Table:
        rng = np.random.default_rng(seed)
        points = _units(sample.sort_by("chunk_id")["embedding"], dimensions)

        def by_angle(p, c):
            return np.argmax(p @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T, axis=1)

        centres = _means(points, cells, by_angle, rounds, rng)
        centres = (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        rest = (points - centres[np.argmax(points @ centres.T, axis=1)]).reshape(len(points), -1, CODE_WIDTH)
        books = [_means(np.ascontiguousarray(rest[:, p]), ENTRIES, _nearest, rounds, rng) for p in range(rest.shape[1])]
        model = _Model(centres, np.stack(books).astype(np.float32))
        row = (len(centres), dimensions, centres.tobytes(), model.books.tobytes(), *_measured(points, model))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.table({n: pa.array([v], t) for n, v, t in zip(MODEL_ROW, row, kinds)})

    return run


def train(embeddings: DataFrame, dimensions: int, cells: int | None = None, seed: int = 7, rounds: int = 12) -> DataFrame:
    """One model row, or none without vectors. By default the root of the number of vectors is the number of cells."""
    if dimensions % CODE_WIDTH:
        raise ValueError(f"the width of vectors must be a multiple of {CODE_WIDTH}")
    known = embeddings.where("embedding IS NOT NULL").select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    count = known.count()
    cells = min(cells or max(8, round(math.sqrt(count))), MOST_CELLS)
    sample = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_ROWS)
    return cut_lineage(sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fit(cells, dimensions, seed, rounds), MODEL))


def _assigned(model: _Model, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = _units(batch["embedding"], dimensions)
            cell = model.assign(matrix)
            codes = pa.array([c.tobytes() for c in model.encode(matrix, cell)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["repository_id"], pa.array(cell.astype(np.int32)), batch["chunk_id"], codes], names=["repository_id", "cell", "chunk_id", "code"]
            )

    return run


def build(embeddings: DataFrame, model: DataFrame) -> DataFrame:
    """The blocks of all vectors (repository_id, chunk_id, embedding)."""
    known = embeddings.where("embedding IS NOT NULL").select("repository_id", F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    row = model.first()
    kind = "repository_id string, cell int, chunk_id string, code binary"
    if row is None:
        placed = known.sparkSession.createDataFrame([], kind)
    else:
        placed = cut_lineage(known.mapInArrow(_assigned(_Model.read(row), row["dimensions"]), kind))
    sizes = placed.groupBy("repository_id", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    dealt = placed.join(sizes, ["repository_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts"))
    blocks = dealt.groupBy("repository_id", "cell", "part").agg(F.collect_list(F.struct("chunk_id", "code")).alias("rows"))
    return blocks.select((F.col("cell") % FOLDERS).cast("int").alias("folder"), "repository_id", "cell", "rows")


def _probed(model: _Model, dimensions: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = _units(batch["embedding"], dimensions)
            near = matrix @ model.centres.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
            flat = cells.ravel().astype(np.int32)
            vectors_ = pa.array([v.tobytes() for v in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["repository_id"].take(rows), pa.array(flat), batch["query_id"].take(rows), vectors_.take(rows)],
                names=["repository_id", "cell", "query_id", "vector"],
            )

    return run


def _by_code(model: _Model, most: int):
    """The vectors of a block that come first by code for each query of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, rows, asked in zip(batch["cell"], batch["rows"], batch["queries"]):
                held, queries = rows.values, asked.values
                codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(held), -1)
                matrix = np.frombuffer(b"".join(queries.field("vector").to_pylist()), np.float32).reshape(len(queries), -1)
                parts = matrix.reshape(len(matrix), -1, CODE_WIDTH)
                tables = np.einsum("qpw,pew->qpe", parts, model.books)
                score = np.repeat(matrix @ model.centres[cell.as_py()][:, None], len(held), axis=1)
                for part in range(codes.shape[1]):
                    score += tables[:, part][:, codes[:, part]]
                keep = min(most, len(held))
                best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
                at = pa.array(np.repeat(np.arange(len(queries)), keep))
                yield pa.RecordBatch.from_arrays(
                    [queries.field("query_id").take(at), held.field("chunk_id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel().astype(np.float64))],
                    names=["query_id", "chunk_id", "near"],
                )

    return run


def probe_cells(queries: DataFrame, model: DataFrame, probes: int) -> DataFrame:
    """(repository_id, cell, folder, query_id, vector) of the cells nearest to each query."""
    kind = "repository_id string, cell int, query_id string, vector binary"
    known = queries.where("embedding IS NOT NULL").select("repository_id", F.col("query_id").cast("string").alias("query_id"), "embedding")
    row = model.first()
    if row is None:
        found = queries.sparkSession.createDataFrame([], kind)
    else:
        found = known.mapInArrow(_probed(_Model.read(row), row["dimensions"], probes), kind)
    return found.withColumn("folder", (F.col("cell") % FOLDERS).cast("int"))


def ivf_top_k(
    queries: DataFrame, index: VectorIndex, embeddings: DataFrame, k: int, probes: int | None = None, refine: int | None = None
) -> DataFrame:
    """Approximate cosine top-k per query within its repository: probed cells, ordered by code, best reranked.

    ``refine * k`` vectors of a query are scored exactly. Scores are those of the exact search.
    """
    row = index.model.first()
    probes = probes or (row["probes"] if row else 1)
    refine = refine or (row["refine"] if row else 1)
    asked = cut_lineage(probe_cells(queries, index.model, probes))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    grouped = asked.groupBy("folder", "repository_id", "cell", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).agg(
        F.collect_list(F.struct("query_id", "vector")).alias("queries")
    )
    pairs = in_folders(index.blocks, "folder", asked).join(grouped, ["folder", "repository_id", "cell"]).select("cell", "rows", "queries")
    kind = "query_id string, chunk_id string, near double"
    hits = pairs.mapInArrow(_by_code(_Model.read(row), refine * k), kind) if row else queries.sparkSession.createDataFrame([], kind)
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id")
    wanted = cut_lineage(hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= refine * k).select("query_id", "chunk_id"))
    scored = vectors.similarity_for_pairs(
        wanted, queries.withColumn("query_id", F.col("query_id").cast("string")), embeddings.withColumn("chunk_id", F.col("chunk_id").cast("string"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    return scored.withColumn("semantic_rank", F.row_number().over(best)).where(F.col("semantic_rank") <= k)


def read_share(queries: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """Per query, the share of its repository's vectors whose codes lie in the probed cells."""
    row = index.model.first()
    asked = probe_cells(queries, index.model, probes or (row["probes"] if row else 1))
    sizes = index.blocks.groupBy("repository_id", "cell").agg(F.sum(F.size("rows")).alias("rows"))
    whole = sizes.groupBy("repository_id").agg(F.sum("rows").alias("whole"))
    read = asked.join(sizes, ["repository_id", "cell"], "left").groupBy("query_id", "repository_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("read"))
    return read.join(whole, "repository_id").select("query_id", (F.col("read") / F.col("whole")).alias("share"))
