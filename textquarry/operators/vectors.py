"""Embeddings: text, reuse, batching, exact and approximate nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import vectors

MAX_BATCH_ITEMS = 64
MAX_BATCH_CHARS = 240_000
SCORE_DIGITS = 9
BLOCK_ROWS = 1_024


def embedding_text(chunks: DataFrame, repository_name: Column | None = None) -> DataFrame:
    """Adds the text that is embedded, whole: a stable header, a blank line and the content."""
    parent, symbol = F.nullif("parent_symbol", F.lit("")), F.nullif("symbol", F.lit(""))
    header = [
        F.concat(F.lit("Repository: "), F.col("repository_id") if repository_name is None else repository_name),
        F.concat(F.lit("Path: "), "path"),
        F.concat(F.lit("Language: "), "language"),
        F.concat(F.lit("Kind: "), "chunk_type"),
        F.when(symbol.isNotNull(), F.concat(F.lit("Symbol: "), F.concat_ws(".", parent, symbol))),
        F.concat(F.lit("Parent: "), parent),
        F.lit(""),
        F.col("content"),
    ]
    return chunks.withColumn("embedding_text", F.concat_ws("\n", *header))


def content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.sha2("embedding_text", 256))


REUSE_KEYS = ["repository_id", "content_hash", "provider", "model", "dimensions"]


def reuse_embeddings(
    chunks: DataFrame, previous: DataFrame, provider: str, model: str, dimensions: int
) -> DataFrame:
    """Copy vectors forward where repository, hash, provider, model and width all match.

    ``previous`` is first reduced to one vector per key, so copies of one text cannot multiply.
    Rows left with a null embedding are the ones to embed.
    """
    known = previous.groupBy(*REUSE_KEYS).agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    wanted = (
        chunks.withColumn("provider", F.lit(provider))
        .withColumn("model", F.lit(model))
        .withColumn("dimensions", F.lit(dimensions))
    )
    return wanted.join(known, REUSE_KEYS, "left").withColumn(
        "reused", F.col("embedding").isNotNull()
    )


def pack_batches(
    df: DataFrame,
    text_col: str = "embedding_text",
    max_items: int = MAX_BATCH_ITEMS,
    max_chars: int = MAX_BATCH_CHARS,
    group_rows: int = 4_096,
) -> DataFrame:
    """Adds (batch_group, batch_id): greedy batches in chunk_id order, the same in every run.

    The chunks of a repository are dealt by hash to groups of about ``group_rows``; a batch never
    crosses groups. Only ids and lengths meet in the walk. A text longer than a batch is alone in
    it and stays whole, so an embedder with a shorter input must cut it into parts itself.
    """
    counts = df.groupBy("repository_id").agg(F.count("*").alias("_rows"))
    slot = F.conv(F.left(F.md5("chunk_id"), F.lit(8)), 16, 10).cast("bigint")
    keyed = df.join(counts, "repository_id").withColumn(
        "batch_group", (slot % F.ceil(F.col("_rows") / group_rows)).cast("int")
    )

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_id", kind="stable")
        batch, items, chars, ids = 0, 0, 0, []
        for value in rows["chars"].tolist():
            if items and (items >= max_items or chars + value > max_chars):
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + value
            ids.append(batch)
        return rows[["repository_id", "chunk_id"]].assign(batch_id=ids)

    narrow = keyed.select("repository_id", "batch_group", "chunk_id", F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    walked = narrow.groupBy("repository_id", "batch_group").applyInPandas(
        walk, "repository_id string, chunk_id string, batch_id bigint"
    )
    return keyed.drop("_rows").join(walked, ["repository_id", "chunk_id"])


Embedder = Callable[[pd.Series, str], np.ndarray]


def embed(df: DataFrame, embedder: Embedder, kind: str, dimensions: int, text_col: str = "embedding_text") -> DataFrame:
    """Apply a text-to-vector function batch by batch; order, count and width are checked.

    ``embedder(texts, kind)`` returns a (rows, dimensions) array; kind is "document" or "query".
    """
    schema = df.withColumn("embedding", F.array().cast("array<double>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            matrix = np.asarray(embedder(frame[text_col], kind), dtype="float64")
            if matrix.shape != (len(frame), dimensions):
                raise ValueError(f"expected {(len(frame), dimensions)} values, got {matrix.shape}")
            yield frame.assign(embedding=list(matrix))

    return df.mapInPandas(run, schema)


def term_bucket(term: Column, dimensions: int) -> Column:
    return (F.conv(F.left(F.md5(term), F.lit(8)), 16, 10).cast("bigint") % dimensions).cast("int")


def term_sign(term: Column) -> Column:
    return F.when(F.substring(F.md5(term), 9, 1).isin(*"01234567"), 1.0).otherwise(-1.0)


def hashed_embeddings(term_rows: DataFrame, keys: list[str], dimensions: int) -> DataFrame:
    """Default embedder: each term adds its signed frequency to a hashed position, then unit length.

    ``term_rows`` carries the keys, ``term`` and ``tf``. A vector is one row of sums, which combine
    before the only shuffle; frequencies are whole numbers, so their order does not matter.
    """
    value = F.col("tf") * term_sign(F.col("term"))
    placed = term_rows.select(*keys, term_bucket(F.col("term"), dimensions).alias("_slot"), value.alias("_value"))
    sums = [F.coalesce(F.sum(F.when(F.col("_slot") == i, F.col("_value"))), F.lit(0.0)) for i in range(dimensions)]
    return placed.groupBy(*keys).agg(F.array(*sums).alias("_dense")).select(*keys, vectors.unit(F.col("_dense")).alias("embedding"))


def _dense_terms(dimensions: int, fields: tuple[str, ...]):
    """The vectors of ``hashed_embeddings`` for arrays of terms, whose ``fields`` add up to the frequency; each distinct term is hashed once a batch."""

    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        flat = rows.flatten()
        coded = flat.field("term").dictionary_encode()
        digests = [hashlib.md5(term.encode()).hexdigest() for term in coded.dictionary.to_pylist()]
        slots = np.array([int(d[:8], 16) % dimensions for d in digests], np.int64)
        signs = np.array([1.0 if d[8] in "01234567" else -1.0 for d in digests])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), sizes)
        tf = sum(flat.field(name).to_numpy(zero_copy_only=False) for name in fields)
        value = tf * signs[codes]
        dense = np.bincount(row * dimensions + slots[codes], value, len(rows) * dimensions).reshape(-1, dimensions)
        # Sums are whole numbers, so this is what vectors.unit gives, to the bit.
        length = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        dense = np.divide(dense, length, out=dense, where=length > 0).ravel()
        edges = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimensions)
        return pa.ListArray.from_arrays(edges, pa.array(dense + 0.0, pa.float64()))

    return F.arrow_udf(run, "array<double>")


def hashed_vector(terms: Column, dimensions: int, fields: tuple[str, ...] = ("tf",)) -> Column:
    """The vector of ``hashed_embeddings`` from an array of terms in the row; null without terms."""
    return F.when(F.size(terms) > 0, _dense_terms(dimensions, fields)(terms))


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, vectors.unit(F.col(column)))


def vector_reason(dimensions: int, model: str | None = None) -> Column:
    """Why a row may not be ranked, null if it may."""
    reason = F.when(F.size("embedding") != dimensions, "wrong_width")
    return reason if model is None else reason.when(~F.col("model").eqNullSafe(F.lit(model)), "other_model")


def validate_vectors(embeddings: DataFrame, dimensions: int, model: str | None = None) -> DataFrame:
    """Rows that may not be ranked, with the reason."""
    return embeddings.withColumn("reason", vector_reason(dimensions, model)).where(F.col("reason").isNotNull())


# ---- exact search ------------------------------------------------------------

BLOCK_SCHEMA = "repository_id string, ids array<string>, data binary"


def _pack_blocks(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """Unit vectors packed into blocks of at most ``rows`` per repository, without a shuffle."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repository, part in frame.groupby("repository_id", sort=False):
                for at in range(0, len(part), rows):
                    piece = part.iloc[at : at + rows]
                    matrix = np.stack(piece["embedding"].to_numpy()).astype("float64")
                    length = np.linalg.norm(matrix, axis=1, keepdims=True)
                    matrix = np.divide(matrix, length, out=np.full_like(matrix, np.nan), where=length > 0)
                    yield pd.DataFrame(
                        {"repository_id": [repository], "ids": [piece[id_col].tolist()], "data": [matrix.tobytes()]}
                    )

    return df.select("repository_id", F.col(id_col).cast("string").alias(id_col), "embedding").mapInPandas(
        pack, BLOCK_SCHEMA
    )


def _block_top_k(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor: dict[str, float] = {}  # weakest score still of interest per query in this task
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                left = np.frombuffer(row.q_data).reshape(len(row.q_ids), -1)
                right = np.frombuffer(row.data).reshape(len(row.ids), -1)
                scores = np.round(left @ right.T, SCORE_DIGITS)
                ids = np.asarray(row.ids, dtype=object)
                for q, query in enumerate(row.q_ids):
                    line = np.where(np.isnan(scores[q]), -np.inf, scores[q])
                    wanted = np.nonzero(line >= floor.get(query, -2.0))[0]
                    if len(wanted) > k:
                        # Everything tied with the k-th best stays: ties are settled by id later.
                        kth = np.partition(line[wanted], len(wanted) - k)[len(wanted) - k]
                        floor[query] = max(kth, floor.get(query, -2.0))
                        wanted = wanted[line[wanted] >= kth]
                    if len(wanted):
                        out.append(
                            pd.DataFrame({"query_id": query, "chunk_id": ids[wanted], "score": line[wanted]})
                        )
            if out:
                yield pd.concat(out)

    return run


def cosine_top_k(
    queries: DataFrame, embeddings: DataFrame, k: int, salts: int = 32, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact cosine top-k per query within its repository.

    Vectors are packed into blocks and blocks are joined on (repository, salt): the corpus block
    takes one salt, each query block is copied to all salts. So a repository holding most of the
    corpus is spread over ``salts`` keys, and what is shuffled is blocks, never vector pairs.
    Each task keeps only scores that can still reach the top k.

    ``queries`` has query_id, repository_id, embedding; ``embeddings`` has chunk_id,
    repository_id, embedding. Vectors must be of one width (see ``validate_vectors``).
    """
    corpus = _pack_blocks(embeddings, "chunk_id", block_rows).withColumn(
        "salt", F.pmod(F.xxhash64("ids"), F.lit(salts))
    )
    asked = (
        _pack_blocks(queries, "query_id", block_rows)
        .select("repository_id", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    )
    pairs = corpus.join(asked, ["repository_id", "salt"])
    hits = pairs.select("q_ids", "q_data", "ids", "data").mapInPandas(
        _block_top_k(k), "query_id string, chunk_id string, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("semantic_rank", F.row_number().over(best)).where(
        F.col("semantic_rank") <= k
    )


def similarity_for_pairs(pairs: DataFrame, queries: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Cosine score of given (query_id, chunk_id) pairs."""
    return (
        pairs.select("query_id", "chunk_id")
        .join(embeddings.select("chunk_id", F.col("embedding").alias("_c")), "chunk_id")
        .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .select(
            "query_id", "chunk_id",
            F.round(vectors.cosine(F.col("_q"), F.col("_c")), SCORE_DIGITS).alias("score"),
        )
    )


def outside_pool_similarity(
    lexical_hits: DataFrame, semantic_hits: DataFrame, queries: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """Scores of lexical hits that the semantic pool does not hold."""
    missing = lexical_hits.join(semantic_hits, ["query_id", "chunk_id"], "left_anti")
    return similarity_for_pairs(missing, queries, embeddings)


# ---- approximate search ------------------------------------------------------


def hyperplanes(dimensions: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dimensions))


def lsh_signatures(embeddings: DataFrame, id_col: str, dimensions: int, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """One row per vector and table with the sign pattern against fixed random planes."""
    planes = hyperplanes(dimensions, bits, tables, seed)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 2 ** np.arange(bits, dtype="int64")
        for frame in frames:
            matrix = np.stack(frame["embedding"].to_numpy()).astype("float64")
            codes = np.einsum("tbd,nd->ntb", planes, matrix) > 0
            buckets = (codes * powers).sum(axis=2)
            for t in range(tables):
                yield pd.DataFrame(
                    {"repository_id": frame["repository_id"], id_col: frame[id_col], "lsh_table": t, "bucket": buckets[:, t]}
                )

    return embeddings.select(F.col("repository_id"), F.col(id_col).cast("string").alias(id_col), "embedding").mapInPandas(
        sign, f"repository_id string, {id_col} string, lsh_table int, bucket bigint"
    )


def ann_top_k(
    queries: DataFrame, embeddings: DataFrame, k: int, dimensions: int, bits: int = 6, tables: int = 12, salts: int = 16
) -> DataFrame:
    """Approximate top-k: candidates share a sign pattern in some table, then exact rerank.

    Only ids are joined. The corpus side of a bucket is salted, so a bucket holding a large part
    of the corpus is spread over tasks; every candidate of a bucket is reranked, none is capped.
    """
    corpus = lsh_signatures(embeddings, "chunk_id", dimensions, bits, tables).withColumn(
        "salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts))
    )
    asked = lsh_signatures(queries, "query_id", dimensions, bits, tables).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    )
    candidates = (
        corpus.join(asked, ["repository_id", "lsh_table", "bucket", "salt"])
        .select("query_id", "chunk_id")
        .distinct()
    )
    scored = similarity_for_pairs(
        candidates,
        queries.select(F.col("query_id").cast("string").alias("query_id"), "embedding"),
        embeddings.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("semantic_rank", F.row_number().over(best)).where(
        F.col("semantic_rank") <= k
    )


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "chunk_id", F.lit(1).alias("_found"))
    return (
        exact.join(found, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg((F.count("_found") / F.count("*")).alias("recall"))
    )


def embedding_counts(embeddings: DataFrame) -> DataFrame:
    """Vectors per repository and model, and whether the repository can be searched."""
    return embeddings.groupBy("repository_id", "model").agg(
        F.count("embedding").alias("embeddings"), (F.count("embedding") > 0).alias("searchable")
    )
