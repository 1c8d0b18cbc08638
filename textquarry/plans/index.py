"""Index build: from a manifest with content to chunks, postings and embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import terms
from textquarry.operators import chunking, filters, lexical, lexical_index, symbol_index, vector_index, vectors
from textquarry.operators.lexical_index import LexicalIndex
from textquarry.operators.symbol_index import SymbolIndex
from textquarry.operators.vector_index import VectorIndex
from textquarry.session import cut_lineage
from textquarry.settings import INDEX, IndexLimits
from textquarry.sources import sinks

PROVIDER = "hashed"
MODEL = "hashed-terms"
DIMENSIONS = 64


@dataclass(frozen=True)
class CorpusIndex:
    """The tables of an index; ``lexical``, ``cells`` and ``symbols`` come with a published one.

    ``cut`` gives the chunks of a stored table of files, one that is built and not yet published has it.
    """

    decisions: DataFrame
    files: DataFrame
    chunks: DataFrame
    postings: DataFrame
    embeddings: DataFrame
    lexical: LexicalIndex | None = None
    cells: VectorIndex | None = None
    symbols: SymbolIndex | None = None
    cut: Callable[[DataFrame], DataFrame] | None = None


def select_files(manifest: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Every manifest entry with its skip_reason, null for those to index.

    Metadata is judged without content; only position and size enter the budget walk.
    """
    judged = filters.metadata_decision(manifest, limits)
    refused = judged.where(F.col("skip_reason").isNotNull())
    passed = judged.where(F.col("skip_reason").isNull())
    budgeted = filters.apply_budgets(passed.drop("skip_reason"), limits)
    return refused.unionByName(budgeted.select(*refused.columns))


def read_files(decisions: DataFrame, one_per_blob: bool = True) -> DataFrame:
    """Accepted entries that hold text, by default one per blob."""
    accepted = decisions.where(F.col("skip_reason").isNull()).drop("skip_reason")
    if one_per_blob:
        accepted = filters.dedupe_by_blob(accepted)
    data = accepted.withColumn("content", F.col("content").cast("binary"))
    judged = filters.content_decision(data)
    text = judged.where(F.col("skip_reason").isNull())
    return chunking.spans_by_pattern(text.withColumn("content", F.col("content").cast("string")))


def term_rows(postings: DataFrame) -> DataFrame:
    return postings.select(
        "repository_id", "chunk_id", "term", (F.col("tf_names") + F.col("tf_body")).alias("tf")
    )


def chunk_vectors(postings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Default vectors straight from the inverted index; no text is read again.

    Of packed postings each chunk is one row with its vector, so nothing is shuffled.
    """
    if "terms" not in postings.columns:
        return vectors.hashed_embeddings(term_rows(postings), ["repository_id", "chunk_id"], dimensions)
    held = postings.where(F.size("terms") > 0)
    vector = vectors.hashed_vector(F.col("terms"), dimensions, ("tf_names", "tf_body"))
    return held.select("repository_id", "chunk_id", vector.alias("embedding"))


def query_vectors(queries: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    rows = queries.select(
        "query_id", "repository_id", F.explode(terms.text_terms(F.col("text"))).alias("term"), F.lit(1).alias("tf")
    )
    return vectors.hashed_embeddings(rows, ["query_id", "repository_id"], dimensions)


def build_index(manifest: DataFrame, limits: IndexLimits = INDEX, dimensions: int = DIMENSIONS) -> CorpusIndex:
    """All index tables as DataFrames of one lineage; limits that are named are applied at once."""
    decisions = select_files(manifest, limits)
    texts = read_files(decisions)
    chunks = chunking.chunk_files(texts, limits)
    postings = lexical.packed_postings(chunks)
    spans_known = texts.withColumn("has_spans", F.size("spans") > 0)
    return CorpusIndex(  # postings are packed, a row per chunk; searches take them so
        decisions=decisions.drop("content"),
        files=filters.prepare_files(spans_known),
        chunks=chunks,
        postings=postings,
        embeddings=chunk_vectors(postings, dimensions),
        cut=lambda files: chunking.chunk_files(chunking.spans_by_pattern(files), limits),
    )


TABLES = ("decisions", "files", "chunks", "postings", "embeddings")


def hashed_chunks(chunks: DataFrame) -> DataFrame:
    """Every chunk with the hash of the text that is embedded."""
    return vectors.content_hash(vectors.embedding_text(chunks)).select("repository_id", "chunk_id", "content_hash")


def chunk_embeddings(chunks: DataFrame, postings: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A vector for every chunk, copied from ``previous`` where its text was embedded before.

    The default vectors are made in the rows of the postings, since terms are far wider than their vector;
    those of chunks that are left join them.
    """
    hashed = hashed_chunks(chunks)
    if previous is None:
        none = hashed.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("reused", F.lit(False))
        known = none.select("*", F.lit(PROVIDER).alias("provider"), F.lit(MODEL).alias("model"), F.lit(DIMENSIONS).alias("dimensions"))
    else:
        known = vectors.reuse_embeddings(hashed, previous, PROVIDER, MODEL, DIMENSIONS)
    columns = ["repository_id", "chunk_id", "content_hash", "provider", "model", "dimensions", "embedding", "reused"]
    known = cut_lineage(known.select(*columns))
    missing = known.where("not reused").drop("embedding")
    fresh = missing.join(chunk_vectors(lexical.whole_chunks(postings)), ["repository_id", "chunk_id"], "left")
    return known.where("reused").unionByName(fresh.select(*columns))


def publish_index(
    index: CorpusIndex, path: str, previous: CorpusIndex | None = None, replaced: DataFrame | None = None
) -> None:
    """Write the tables as one run, then make it current for its repositories.

    ``replaced`` names the repositories, also those that have become empty; by default the ones
    in the index. Files are written first, and chunks and the later tables are derived from what was
    written, so the corpus is shuffled, cut and tokenised once. Readers see either the old run of all tables
    or the new one.
    """
    run = uuid.uuid4().hex
    write = lambda df, name: sinks.write_run(df, f"{path}/{name}", run)
    decisions = write(index.decisions, "decisions")
    files = write(index.files, "files")
    chunks = write(index.chunks if index.cut is None else index.cut(files), "chunks")
    postings = write(lexical.packed_postings(lexical_index.numbered(chunks), ["segment", "slot"]), "postings")
    write_lexical(path, run, chunks, postings)
    write_symbols(path, run, chunks)
    embeddings = write(chunk_embeddings(chunks, postings, None if previous is None else previous.embeddings), "embeddings")
    write_cells(path, run, embeddings, DIMENSIONS)
    sinks.publish_run(decisions if replaced is None else replaced, f"{path}/runs", run)


LEXICAL_TABLES = ("blocks", "places", "term_counts", "repository_counts")


def write_lexical(path: str, run: str, chunks: DataFrame, postings: DataFrame) -> None:
    """The blocks and counts of one run; ``postings`` carry segment and slot."""
    blocks = sinks.write_run(lexical_index.stored_blocks(postings), f"{path}/blocks", run, ["bucket"])
    sinks.write_run(lexical_index.places(postings), f"{path}/places", run)
    sinks.write_run(lexical_index.block_counts(blocks), f"{path}/term_counts", run)
    sinks.write_run(lexical_index.repository_counts(chunks, postings), f"{path}/repository_counts", run)


SYMBOL_TABLES = ("symbol_pieces", "symbol_counts", "symbol_holders")


def write_symbols(path: str, run: str, chunks: DataFrame) -> None:
    """The symbol dictionary of one run."""
    made = symbol_index.build_symbols(chunks)
    for name, rows in zip(SYMBOL_TABLES, (made.pieces, made.counts, made.holders)):
        folders = ["bucket"] if "bucket" in rows.columns else []
        sinks.write_run(rows.repartition(*folders) if folders else rows, f"{path}/{name}", run, folders)


def write_cells(path: str, run: str, embeddings: DataFrame, dimensions: int) -> None:
    """The inverted file over the vectors of one run.

    The first run fits the model, on a sample of its vectors; later ones assign their vectors to the
    same cells, so all runs can be probed alike.
    """
    spark = embeddings.sparkSession
    if not sinks.exists(spark, f"{path}/cell_model") or spark.read.parquet(f"{path}/cell_model").isEmpty():
        vector_index.train(embeddings, dimensions).write.mode("overwrite").parquet(f"{path}/cell_model")
    model = spark.read.parquet(f"{path}/cell_model")
    blocks = vector_index.build(embeddings, model)
    sinks.write_run(blocks.repartition("folder"), f"{path}/cells", run, ["folder"])


def load_index(spark, path: str) -> CorpusIndex:
    """The current rows of a published index."""
    runs = spark.read.parquet(f"{path}/runs")
    read = lambda name: sinks.current_rows(sinks.read_table(spark, f"{path}/{name}"), runs)
    return CorpusIndex(
        *map(read, TABLES),
        lexical=LexicalIndex(*map(read, LEXICAL_TABLES)),
        cells=VectorIndex(read("cells"), spark.read.parquet(f"{path}/cell_model")),
        symbols=SymbolIndex(*map(read, SYMBOL_TABLES)),
    )


def open_tables(spark, path: str) -> CorpusIndex:
    """Index tables written side by side, without runs."""
    return CorpusIndex(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))
