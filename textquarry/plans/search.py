"""Hybrid search: semantic and lexical retrieval fused per query, for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators import fusion, lexical, lexical_index, vector_index, vectors
from textquarry.operators.lexical_index import LexicalIndex
from textquarry.operators.vector_index import VectorIndex
from textquarry.plans.index import query_vectors
from textquarry.session import cut_lineage
from textquarry.settings import CONTEXT, SEARCH, ContextSettings, SearchSettings


@dataclass(frozen=True)
class SearchResult:
    """``candidates``: every pooled chunk with its signals and final rank (0 for a duplicate);
    ``strengths``: evidence signals and strength per query."""

    candidates: DataFrame
    strengths: DataFrame

    def sources(self, top_k: int | None = None, settings: SearchSettings = SEARCH) -> DataFrame:
        """Ranked sources, all of them or the first ``top_k`` (as many as asked)."""
        ranked = self.candidates.where(F.col("rank") > 0)
        if top_k is None:
            return ranked
        return ranked.where(F.col("rank") <= top_k)


def refused_queries(queries: DataFrame, embeddings: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """query_id, repository_id, reason of queries that may not be ranked.

    A repository is searched with the model that made its vectors: without vectors it can't be
    searched (no_embeddings), nor with only those of another model or width (other_model).
    """
    fits = F.col("provider").eqNullSafe(F.lit(provider)) & F.col("model").eqNullSafe(F.lit(model)) & F.col("dimensions").eqNullSafe(F.lit(dimensions))
    usable = F.col("embedding").isNotNull() & fits & (F.size("embedding") == dimensions)
    held = embeddings.groupBy("repository_id").agg(F.count_if(F.col("embedding").isNotNull()).alias("_any"), F.count_if(usable).alias("_usable"))
    reason = F.when(F.coalesce("_any", F.lit(0)) == 0, "no_embeddings").when(F.col("_usable") == 0, "other_model")
    judged = queries.select("query_id", "repository_id").join(held, "repository_id", "left").withColumn("reason", reason)
    return judged.where(F.col("reason").isNotNull()).select("query_id", "repository_id", "reason")


def usable_vectors(embeddings: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """The vectors of one provider, model and width; others are never compared with a question."""
    named = embeddings.where(F.col("provider").eqNullSafe(F.lit(provider)) & F.col("dimensions").eqNullSafe(F.lit(dimensions)))
    wrong = vectors.vector_reason(dimensions, model)
    return named.where(F.col("embedding").isNotNull() & wrong.isNull())


def retrieve_pool(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame,
    embeddings: DataFrame,
    query_embeddings: DataFrame,
    settings: SearchSettings = SEARCH,
    blocks: LexicalIndex | None = None,
    cells: VectorIndex | None = None,
) -> DataFrame:
    """Candidate pool with details: at most semantic + lexical candidates per query.

    The pool of hits is materialised once, since its ids drive three lookups; content is joined
    only to pooled ids. Duplicate-free ids make both lookups plain joins with a small side. With
    ``blocks``, statistics and full-text hits come from the block index instead of ``postings``; with
    ``cells``, semantic hits come from the probed cells, approximately.
    """
    asked = lexical.query_terms(queries)
    # One row per asked term, read three times below.
    if blocks is None:
        stats = cut_lineage(lexical.term_statistics(postings, chunks, asked))
        found = lexical.lexical_search(postings, stats, asked, settings.lexical_candidates)
    else:
        stats = cut_lineage(lexical_index.stored_statistics(blocks, asked))
        found = lexical_index.block_search(blocks, stats, asked, settings.lexical_candidates)
    lexical_hits = lexical.coverage(found, stats, asked).select("query_id", "chunk_id", "text_rank", "coverage", "matched_terms")
    if cells is None:
        semantic_hits = vectors.cosine_top_k(query_embeddings, embeddings, settings.semantic_candidates)
    else:
        semantic_hits = vector_index.ivf_top_k(query_embeddings, cells, embeddings, settings.semantic_candidates)
    hits = cut_lineage(
        semantic_hits.withColumnRenamed("score", "semantic_score").join(
            lexical_hits.withColumn("query_id", F.col("query_id").cast("string")),
            ["query_id", "chunk_id"],
            "full_outer",
        )
    )
    missing = hits.where(F.col("semantic_rank").isNull())
    extra = vectors.similarity_for_pairs(
        missing, query_embeddings.withColumn("query_id", F.col("query_id").cast("string")), embeddings
    )
    semantic = hits.where(F.col("semantic_rank").isNotNull()).withColumnRenamed("semantic_score", "score")
    lexical_side = hits.where(F.col("text_rank").isNotNull())
    pool = fusion.candidate_pool(semantic, lexical_side, extra)
    questions = lexical.query_identifiers(
        queries.select(F.col("query_id").cast("string").alias("query_id"), "text")
    ).drop("text")
    return pool.join(questions, "query_id").join(chunks, "chunk_id")


def rank_candidates(pool: DataFrame, settings: SearchSettings = SEARCH) -> SearchResult:
    """Fuse, de-duplicate and judge a detailed pool."""
    signalled = fusion.semantic_excess(fusion.exact_signals(pool), settings)
    fused = cut_lineage(fusion.rrf(fusion.list_ranks(signalled), settings.rrf_k))
    kept = fusion.dedupe_near(fusion.dedupe_exact(fused), settings)
    order = Window.partitionBy("query_id").orderBy("fused_rank")
    final = kept.select("query_id", "chunk_id", F.row_number().over(order).alias("_rank"))
    candidates = cut_lineage(
        fused.join(final, ["query_id", "chunk_id"], "left")
        .withColumn("rank", F.coalesce("_rank", F.lit(0)))
        .withColumn("kept", F.col("rank") > 0)
        .drop("_rank")
    )
    strengths = fusion.evidence_strength(fusion.evidence_signals(candidates, settings), settings)
    return SearchResult(candidates, strengths)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame,
    embeddings: DataFrame,
    settings: SearchSettings = SEARCH,
    query_embeddings: DataFrame | None = None,
    blocks: LexicalIndex | None = None,
    cells: VectorIndex | None = None,
    model: tuple[str, str, int] | None = None,
) -> SearchResult:
    """``queries`` has query_id, repository_id and text.

    With ``model`` (provider, name, width of the query vectors) only vectors of that model are
    ranked, and queries of repositories without any are left out (``refused_queries`` names them).
    """
    if query_embeddings is None:
        query_embeddings = query_vectors(queries)
    if model is not None:
        refused = cut_lineage(refused_queries(queries, embeddings, *model).select("query_id"))
        queries = queries.join(refused, "query_id", "left_anti")
        query_embeddings = query_embeddings.join(refused, "query_id", "left_anti")
        embeddings = usable_vectors(embeddings, *model)
    pool = retrieve_pool(queries, chunks, postings, embeddings, query_embeddings, settings, blocks, cells)
    return rank_candidates(pool, settings)


def search_summary(
    result: SearchResult, chunks: DataFrame, selected: DataFrame, context: ContextSettings = CONTEXT
) -> DataFrame:
    """Inspector row per query: list sizes, strength, chunks searched and context use."""
    searched = chunks.groupBy("repository_id").agg(F.count("*").alias("searched_chunks"))

    def count(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    lists = result.candidates.groupBy("query_id", "repository_id").agg(
        count(F.col("kept"), "sources"),
        count(F.col("semantic_rank").isNotNull(), "semantic_candidates"),
        count(F.col("lexical_rank").isNotNull(), "lexical_candidates"),
        F.count_distinct(F.when(F.col("kept"), F.col("path"))).alias("distinct_files"),
    )
    used = selected.where(F.col("label").isNotNull()).groupBy("query_id").agg(
        F.sum(F.length("content")).alias("context_chars"), F.count("*").alias("selected_sources")
    )
    zero = F.lit(0).cast("bigint")
    return (
        lists.join(result.strengths.select("query_id", "strength"), "query_id")
        .join(searched, "repository_id")
        .join(used, "query_id", "left")
        .withColumn("context_chars", F.coalesce("context_chars", zero))
        .withColumn("selected_sources", F.coalesce("selected_sources", zero))
        .withColumn("context_budget", F.lit(context.max_chars))
    )
