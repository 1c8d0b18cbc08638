"""Hybrid search of the benchmark passages over the documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog import search_sql as sql
from textquarry.catalog.base import corpus_index, query, with_ctes
from textquarry.catalog.terms import SEARCHED_SQL, benchmark_queries
from textquarry.operators import fusion
from textquarry.plans import index as plan
from textquarry.plans import search

POOLED = (*SEARCHED_SQL, sql.SEMANTIC_SQL, sql.POOL_SQL)
SIGNALLED = (*POOLED, sql.SIGNALS_SQL)
EXCESSED = (*SIGNALLED, sql.EXCESS_SQL)
FUSED = (*EXCESSED, sql.FUSED_SQL)
ONE_COPY = (*FUSED, sql.EXACT_KEEP_SQL)
KEPT = (*ONE_COPY, sql.NEAR_KEEP_SQL)
JUDGED = (*KEPT, sql.STRENGTH_SQL)


def pooled(spark, sf_dir):
    index, queries = corpus_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return search.retrieve_pool(
        queries, index.chunks, index.postings, index.embeddings, plan.query_vectors(queries)
    )


def fused(spark, sf_dir):
    return fusion.rrf(fusion.list_ranks(fusion.semantic_excess(fusion.exact_signals(pooled(spark, sf_dir)))))


def searched(spark, sf_dir) -> search.SearchResult:
    index, queries = corpus_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    return search.hybrid_search(queries, index.chunks, index.postings, index.embeddings)


def number(column: str):
    """Ids were text during the search; give them back as numbers."""
    return F.col(column).cast("bigint").alias(column)


def or_zero(column: str):
    return F.coalesce(F.col(column), F.lit(0)).alias(column)


@query(
    "candidate_pool",
    with_ctes(
        *POOLED,
        select="""SELECT query_id, chunk_id, score, coalesce(semantic_rank, 0) AS semantic_rank,
                         text_rank, coverage, matched_terms FROM pool""",
    ),
)
def candidate_pool(spark, sf_dir):
    return pooled(spark, sf_dir).select(
        number("query_id"), "chunk_id", F.col("score"), or_zero("semantic_rank"),
        F.col("text_rank"), F.col("coverage"),
        F.array_join("matched_terms", " ").alias("matched_terms"),
    )


@query(
    "exact_signals",
    with_ctes(
        *SIGNALLED,
        select="""SELECT query_id, chunk_id, coalesce(named_as, '') AS named_as, mentioned,
                         coalesce(exact_match, '') AS exact_match, low_value FROM exact""",
    ),
)
def exact_signals(spark, sf_dir):
    return fusion.exact_signals(pooled(spark, sf_dir)).select(
        number("query_id"), "chunk_id", F.coalesce("named_as", F.lit("")).alias("named_as"), "mentioned",
        F.coalesce("exact_match", F.lit("")).alias("exact_match"), "low_value",
    )


@query(
    "list_ranks",
    with_ctes(
        *FUSED,
        select="""SELECT query_id, chunk_id, coalesce(semantic_rank, 0) AS semantic_rank, coalesce(lexical_rank, 0) AS lexical_rank,
                         coalesce(named_rank, 0) AS named_rank, coalesce(mention_rank, 0) AS mention_rank FROM ranked_lists""",
    ),
)
def list_ranks(spark, sf_dir):
    ranked = fusion.list_ranks(fusion.exact_signals(pooled(spark, sf_dir)))
    return ranked.select(number("query_id"), "chunk_id", *(or_zero(column) for column in fusion.RANK_LISTS))


@query(
    "rrf",
    with_ctes(*FUSED, select="SELECT query_id, chunk_id, fused, fused_rank FROM fused_ranks"),
)
def rrf(spark, sf_dir):
    return fused(spark, sf_dir).select(number("query_id"), "chunk_id", F.col("fused"), "fused_rank")


@query(
    "semantic_separation",
    with_ctes(*EXCESSED, select="SELECT query_id, pool_size, semantic_separation FROM separation"),
)
def semantic_separation(spark, sf_dir):
    signalled = fusion.exact_signals(pooled(spark, sf_dir))
    return fusion.semantic_separation(signalled).select(
        number("query_id"), "pool_size", F.col("semantic_separation")
    )


@query(
    "semantic_excess",
    with_ctes(
        *EXCESSED,
        select="""SELECT query_id, chunk_id, semantic_position, semantic_excess FROM excess
                  WHERE semantic_position IS NOT NULL""",
    ),
)
def semantic_excess(spark, sf_dir):
    excess = fusion.semantic_excess(fusion.exact_signals(pooled(spark, sf_dir)))
    return excess.where("semantic_position is not null").select(
        number("query_id"), "chunk_id", "semantic_position", F.col("semantic_excess")
    )


@query("dedupe_exact", with_ctes(*ONE_COPY, select="SELECT query_id, chunk_id, fused_rank FROM one_copy"))
def dedupe_exact(spark, sf_dir):
    return fusion.dedupe_exact(fused(spark, sf_dir)).select(number("query_id"), "chunk_id", "fused_rank")


@query("dedupe_near", with_ctes(*KEPT, select="SELECT query_id, chunk_id, rank FROM candidates WHERE kept"))
def dedupe_near(spark, sf_dir):
    return searched(spark, sf_dir).sources().select(number("query_id"), "chunk_id", "rank")


@query(
    "near_duplicate_matches",
    with_ctes(
        *KEPT,
        select="""SELECT d.query_id, d.chunk_id AS dropped_chunk, arg_min(k.chunk_id, k.fused_rank) AS kept_chunk
                  FROM one_copy d JOIN candidates c ON c.query_id = d.query_id AND c.chunk_id = d.chunk_id AND NOT c.kept
                  JOIN one_copy k ON k.query_id = d.query_id AND k.fused_rank < d.fused_rank AND len(k.toks) >= 12
                  JOIN survivors s ON s.query_id = k.query_id AND s.chunk_id = k.chunk_id
                  WHERE len(list_intersect(k.toks, d.toks)) >= 0.9 * (len(k.toks) + len(d.toks) - len(list_intersect(k.toks, d.toks)))
                  GROUP BY d.query_id, d.chunk_id""",
    ),
)
def near_duplicate_matches(spark, sf_dir):
    once = fusion.dedupe_exact(fused(spark, sf_dir))
    kept = fusion.dedupe_near(once)
    return fusion.near_duplicate_matches(once, kept).select(number("query_id"), "dropped_chunk", "kept_chunk")


COUNTS = (
    "evidence_candidates", "exact_matches", "strong_lexical", "partial_lexical", "corroborated", "agreeing_files"
)


@query(
    "evidence_signals",
    with_ctes(
        *JUDGED,
        select=f"SELECT query_id, {', '.join(COUNTS)}, semantic_separation, best_excess AS semantic_excess FROM strengths",
    ),
)
def evidence_signals(spark, sf_dir):
    return searched(spark, sf_dir).strengths.select(
        number("query_id"), *COUNTS, F.col("semantic_separation"),
        F.col("semantic_excess"),
    )


@query("evidence_strength", with_ctes(*JUDGED, select="SELECT query_id, strength FROM strengths"))
def evidence_strength(spark, sf_dir):
    return searched(spark, sf_dir).strengths.select(number("query_id"), "strength")


@query(
    "hybrid_search",
    with_ctes(
        *JUDGED,
        select="""SELECT query_id, rank, chunk_id, path || ':' || start_line || '-' || end_line AS location, fused,
                         score, coverage, coalesce(exact_match, '') AS exact_match, strength
                  FROM candidates JOIN strengths USING (query_id) WHERE rank BETWEEN 1 AND 10""",
    ),
)
def hybrid_search(spark, sf_dir):
    """Ten best sources per question with the strength of its evidence."""
    result = searched(spark, sf_dir)
    return (
        result.sources(top_k=10)
        .join(result.strengths.select("query_id", "strength"), "query_id")
        .select(
            number("query_id"), "rank", "chunk_id",
            F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("location"),
            F.col("fused"), F.col("score"),
            F.col("coverage"), F.coalesce("exact_match", F.lit("")).alias("exact_match"), "strength",
        )
    )
