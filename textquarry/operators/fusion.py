"""Fusion of semantic and lexical hits into one ranking, with a measure of its evidence.

Pools hold at most semantic_candidates + lexical_candidates rows per query, so windows keyed by
query are bounded whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import terms, text, vectors
from textquarry.operators.chunking import let
from textquarry.settings import SEARCH, SearchSettings

SIGNAL_DIGITS = 6


def candidate_pool(semantic: DataFrame, lexical: DataFrame, extra_scores: DataFrame) -> DataFrame:
    """Union of both hit lists per chunk with both sets of signals."""
    left = semantic.select("query_id", "chunk_id", "score", "semantic_rank")
    right = lexical.select("query_id", "chunk_id", "text_rank", "coverage", "matched_terms")
    extra = extra_scores.select("query_id", "chunk_id", F.col("score").alias("_extra"))
    pool = left.join(right, ["query_id", "chunk_id"], "full_outer").join(
        extra, ["query_id", "chunk_id"], "left"
    )
    return pool.select(
        "query_id",
        "chunk_id",
        F.coalesce("score", "_extra", F.lit(0.0)).alias("score"),
        "semantic_rank",
        F.coalesce("text_rank", F.lit(0.0)).alias("text_rank"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("matched_terms", F.array().cast("array<string>")).alias("matched_terms"),
    )


def exact_signals(pool: DataFrame) -> DataFrame:
    """Adds named_as, mentioned, exact_match and low_value.

    Needs ``identifiers`` (of the question), path, symbol, parent_symbol, language and content.
    A symbol match beats a path match; a mention is a verbatim occurrence in the content.
    """
    path = F.lower("path")
    names = F.filter(
        F.transform(F.array("symbol", "parent_symbol"), terms.compact), lambda n: n != ""
    )

    def names_path(token: Column) -> Column:
        bare = F.regexp_replace(F.lower(token), "^/+|/+$", "")
        return (bare.contains(".") | bare.contains("/")) & (
            (path == bare)
            | path.endswith(F.concat(F.lit("/"), bare))
            | (F.element_at(F.split(path, "/"), -1) == bare)
        )

    content = F.lower("content")
    return (
        pool.withColumn(
            "named_as",
            F.when(F.exists("identifiers", lambda t: F.array_contains(names, terms.compact(t))), "symbol")
            .when(F.exists("identifiers", names_path), "path"),
        )
        .withColumn("mentioned", F.exists("identifiers", lambda t: content.contains(F.lower(t))))
        .withColumn(
            "exact_match",
            F.coalesce(F.col("named_as"), F.when(F.col("mentioned"), F.lit("identifier"))),
        )
        .withColumn("low_value", text.is_trivia(F.col("content"), F.col("language")))
    )


def list_ranks(pool: DataFrame) -> DataFrame:
    """Adds lexical_rank, named_rank and mention_rank (semantic_rank comes with the pool)."""
    query = Window.partitionBy("query_id")
    in_lexical = F.size("matched_terms") > 0
    lexical = query.orderBy(
        F.desc(in_lexical.cast("int")), F.desc("coverage"), F.desc("text_rank"), "chunk_id"
    )
    ranked = pool.withColumn("lexical_rank", F.when(in_lexical, F.row_number().over(lexical)))
    tail = (F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("semantic_rank"), F.col("chunk_id"))
    named = query.orderBy(
        F.when(F.col("named_as") == "symbol", 0).when(F.col("named_as") == "path", 1).otherwise(2), *tail
    )
    mention = query.orderBy(F.when(F.col("mentioned"), 0).otherwise(1), *tail)
    return ranked.withColumn(
        "named_rank", F.when(F.col("named_as").isNotNull(), F.row_number().over(named))
    ).withColumn("mention_rank", F.when(F.col("mentioned"), F.row_number().over(mention)))


RANK_LISTS = ("semantic_rank", "lexical_rank", "named_rank", "mention_rank")


def rrf(ranked: DataFrame, k: int = SEARCH.rrf_k) -> DataFrame:
    """Adds ``fused``: reciprocal ranks over the four lists, low-value chunks take no position."""
    total = F.lit(0.0)
    for column in RANK_LISTS:
        counts = F.col(column).isNotNull() & ~F.col("low_value")
        upto = (
            Window.partitionBy("query_id")
            .orderBy(F.asc_nulls_last(column))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        position = F.sum(counts.cast("int")).over(upto)
        total = total + F.when(counts, 1.0 / (k + position)).otherwise(0.0)
    fused = ranked.withColumn("fused", F.round(total, 9))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("fused"), F.asc_nulls_last("semantic_rank"), "chunk_id"
    )
    return fused.withColumn("fused_rank", F.row_number().over(order))


def semantic_separation(pool: DataFrame, settings: SearchSettings = SEARCH) -> DataFrame:
    """Per query: distance of the best score from the rest, in deviations of the rest."""
    scored = _semantic_positions(pool).where(F.col("_k").isNotNull())
    return scored.groupBy("query_id").agg(
        F.count("*").alias("pool_size"),
        F.when(
            F.count("*") >= settings.min_pool,
            F.round(
                F.try_divide(
                    F.max(F.when(F.col("_k") == 1, F.col("score")))
                    - F.avg(F.when(F.col("_k") > 1, F.col("score"))),
                    _spread(F.stddev_pop(F.when(F.col("_k") > 1, F.col("score")))),
                ),
                SIGNAL_DIGITS,
            ),
        ).alias("semantic_separation"),
    )


def _spread(deviation: Column) -> Column:
    """Null for a pool without spread, whatever rounding left of it."""
    return F.when(deviation > 1e-12, deviation)


def _semantic_positions(pool: DataFrame) -> DataFrame:
    """Adds _k: position among the semantic hits that are not low value."""
    counts = F.col("semantic_rank").isNotNull() & ~F.col("low_value")
    upto = (
        Window.partitionBy("query_id")
        .orderBy(F.asc_nulls_last("semantic_rank"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return pool.withColumn("_k", F.when(counts, F.sum(counts.cast("int")).over(upto)))


def semantic_excess(pool: DataFrame, settings: SearchSettings = SEARCH) -> DataFrame:
    """Adds ``semantic_excess``: how far a score stands above what its rank alone explains."""
    placed = _semantic_positions(pool)
    query = Window.partitionBy("query_id")
    rest = F.when(F.col("_k") > 1, F.col("score"))
    n = F.count("_k").over(query)
    z = F.try_divide(
        F.col("score") - F.avg(rest).over(query), _spread(F.stddev_pop(rest).over(query))
    )
    chance = F.greatest(vectors.expected_order_statistic(F.col("_k"), F.col("_n")), F.lit(0.0))
    return (
        placed.withColumn("_n", n)
        .withColumn("_z", z)
        .withColumn(
            "semantic_excess",
            F.when(
                F.col("_k").isNotNull() & (F.col("_n") >= settings.min_pool),
                F.round(F.col("_z") - chance, SIGNAL_DIGITS),
            ),
        )
        .withColumn("semantic_position", F.col("_k"))
        .drop("_k", "_n", "_z")
    )


def fingerprint(content: Column) -> Column:
    """The text with every run of blanks, also those outside ASCII, as one space."""
    return F.trim(F.regexp_replace(content, r"(?U)[\s\x1c-\x1f]+", " "))


def dedupe_exact(ranked: DataFrame) -> DataFrame:
    """Best-ranked row per query and whitespace-insensitive text."""
    copies = Window.partitionBy("query_id", F.sha2(fingerprint(F.col("content")), 256)).orderBy("fused_rank")
    return ranked.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")


def token_set(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def _similar(a: Column, b: Column, threshold: float) -> Column:
    """Jaccard at or above the threshold; sizes too far apart are settled without a set operation."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    jaccard = let(
        F.size(F.array_intersect(a, b)), lambda shared: shared / (F.size(a) + F.size(b) - shared)
    )
    return F.when(small >= threshold * large, jaccard >= threshold).otherwise(False)


def dedupe_near(ranked: DataFrame, settings: SearchSettings = SEARCH) -> DataFrame:
    """Rows that survive: a candidate falls when it nearly repeats one already kept.

    The comparison is with kept rows only, so it depends on order: a fold over the pool of one
    query, which configuration bounds.
    """
    pooled = ranked.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("fused_rank", "chunk_id", token_set(F.col("content")).alias("tokens"))
            )
        ).alias("_rows")
    )
    begin = F.array().cast("array<struct<fused_rank:int,chunk_id:string,tokens:array<string>>>")

    def step(kept: Column, row: Column) -> Column:
        long_enough = F.size(row["tokens"]) >= settings.near_min_tokens
        repeats = long_enough & F.exists(
            kept,
            lambda other: (F.size(other["tokens"]) >= settings.near_min_tokens)
            & _similar(other["tokens"], row["tokens"], settings.near_jaccard),
        )
        return F.when(repeats, kept).otherwise(F.array_append(kept, row))

    survivors = pooled.select(
        "query_id", F.explode(F.aggregate("_rows", begin, step)).alias("k")
    ).select("query_id", F.col("k.chunk_id").alias("chunk_id"))
    return ranked.join(survivors, ["query_id", "chunk_id"], "left_semi")


def near_duplicate_matches(
    ranked: DataFrame, kept: DataFrame, settings: SearchSettings = SEARCH
) -> DataFrame:
    """For every dropped candidate the best-ranked kept one it nearly repeats."""
    tokens = token_set(F.col("content")).alias("tokens")
    dropped = ranked.join(kept, ["query_id", "chunk_id"], "left_anti").select(
        "query_id", F.col("chunk_id").alias("dropped_chunk"), F.col("fused_rank").alias("dropped_rank"), tokens
    )
    stays = kept.select(
        "query_id", F.col("chunk_id").alias("kept_chunk"), F.col("fused_rank").alias("kept_rank"),
        F.col("content"),
    ).select("query_id", "kept_chunk", "kept_rank", tokens.alias("kept_tokens"))
    pairs = dropped.join(stays, "query_id").where(
        (F.col("kept_rank") < F.col("dropped_rank"))
        & (F.size("tokens") >= settings.near_min_tokens)
        & (F.size("kept_tokens") >= settings.near_min_tokens)
        & _similar(F.col("tokens"), F.col("kept_tokens"), settings.near_jaccard)
    )
    return pairs.groupBy("query_id", "dropped_chunk").agg(
        F.min_by("kept_chunk", "kept_rank").alias("kept_chunk")
    )


def evidence_signals(ranked: DataFrame, settings: SearchSettings = SEARCH) -> DataFrame:
    """Counts per query that decide the strength of its evidence.

    ``ranked`` carries every candidate, ``kept`` marking the de-duplicated ones; the semantic
    signals look at all candidates, the counts at kept ones only.
    """
    evidence = F.col("kept") & ~F.col("low_value")
    exact = evidence & F.col("exact_match").isNotNull()
    strong = evidence & (F.col("coverage") >= settings.strong_coverage)
    agreed = strong & F.coalesce(F.col("semantic_position") <= settings.agreement_depth, F.lit(False))
    rest = F.when(F.col("semantic_position") > 1, F.col("score"))
    best = F.when(F.col("semantic_position") == 1, F.col("score"))
    return ranked.groupBy("query_id").agg(
        F.count_if(evidence).alias("evidence_candidates"),
        F.count_if(exact).alias("exact_matches"),
        F.count_if(strong).alias("strong_lexical"),
        F.count_if(evidence & (F.size("matched_terms") > 0)).alias("partial_lexical"),
        F.count_if(agreed).alias("corroborated"),
        F.count_distinct(F.when(exact | agreed, F.col("path"))).alias("agreeing_files"),
        F.when(
            F.count("semantic_position") >= settings.min_pool,
            F.round(F.try_divide(F.max(best) - F.avg(rest), _spread(F.stddev_pop(rest))), SIGNAL_DIGITS),
        ).alias("semantic_separation"),
        F.max(F.when(F.col("semantic_position") == 1, F.col("semantic_excess"))).alias("semantic_excess"),
    )


def evidence_strength(signals: DataFrame, settings: SearchSettings = SEARCH) -> DataFrame:
    excess = F.coalesce(F.col("semantic_excess"), F.lit(float("-inf")))
    return signals.withColumn(
        "strength",
        F.when(F.col("evidence_candidates") == 0, "none")
        .when(
            (F.col("exact_matches") > 0)
            | (F.col("corroborated") > 0)
            | (excess >= settings.useful_excess),
            "useful",
        )
        .when((F.col("strong_lexical") > 0) | (excess >= settings.weak_excess), "weak")
        .otherwise("none"),
    )
