"""Citations: stored with answers, resolved from text, ordered for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.context import source_symbol

# Fixed value: a group of source labels with the space before it.
CITATION_GROUP = r"[ \t]*\[(S\d+(?:\s*,\s*S\d+)*)\]"
TITLE_CHARS = 120


def persist_citations(answers: DataFrame, selected: DataFrame) -> DataFrame:
    """One row per included source of an answer, with its location copied."""
    sources = selected.where(F.col("label").isNotNull())
    return answers.select("message_id", "query_id").join(sources, "query_id").select(
        "message_id",
        "chunk_id",
        F.col("label").alias("rank"),
        F.concat(F.lit("S"), F.col("label").cast("string")).alias("label"),
        "path",
        source_symbol().alias("symbol"),
        "start_line",
        "end_line",
        "language",
        "score",
    )


def turn_metadata(answers: DataFrame, selected: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds the retrieval metadata struct of each answer."""
    used = selected.where(F.col("label").isNotNull()).groupBy("query_id").agg(
        F.count("*").alias("sources"),
        F.count_distinct("path").alias("distinct_files"),
        F.sum(F.length("content")).alias("context_chars"),
        F.count_if("truncated").alias("truncated_sources"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        answers.join(used, "query_id", "left")
        .join(summary, "query_id", "left")
        .withColumn(
            "retrieval_metadata",
            F.struct(
                F.coalesce("sources", zero).alias("sources"),
                F.coalesce("distinct_files", zero).alias("distinct_files"),
                # Evidence that did not survive selection is not evidence.
                F.when(F.coalesce("sources", zero) == 0, "none").otherwise(F.col("strength")).alias("strength"),
                "searched_chunks", "semantic_candidates", "lexical_candidates",
                F.coalesce("context_chars", zero).alias("context_chars"),
                "context_budget",
                F.coalesce("truncated_sources", zero).alias("truncated_sources"),
            ),
        )
        .select(*answers.columns, "retrieval_metadata")
    )


def conversation_titles(messages: DataFrame) -> DataFrame:
    """Title of a thread: the beginning of its first question."""
    return (
        messages.where("role = 'user'")
        .groupBy("conversation_id")
        .agg(F.left(F.min_by("content", F.struct("created_at", "message_id")), F.lit(TITLE_CHARS)).alias("title"))
    )


def cited_labels(answer: Column) -> Column:
    groups = F.regexp_extract_all(answer, F.lit(CITATION_GROUP), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))))


def keep_known_citations(answer: Column, known: Column) -> Column:
    """Text with unknown labels removed; a group that loses all its labels goes entirely."""
    pieces = F.split(answer, CITATION_GROUP, -1)
    groups = F.regexp_extract_all(answer, F.lit(CITATION_GROUP), F.lit(0))

    def cleaned(group: Column) -> Column:
        labels = F.filter(
            F.split(F.regexp_extract(group, CITATION_GROUP, 1), r"\s*,\s*"),
            lambda label: F.array_contains(known, label),
        )
        lead = F.regexp_extract(group, r"^([ \t]*)", 1)
        return F.when(F.size(labels) == 0, "").otherwise(
            F.concat(lead, F.lit("["), F.array_join(labels, ", "), F.lit("]"))
        )

    parts = F.transform(
        pieces,
        lambda piece, i: F.concat(
            piece, F.coalesce(cleaned(F.try_element_at(groups, i + 1)), F.lit(""))
        ),
    )
    return F.array_join(parts, "")


def resolve_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Per answer: cited, resolved and unresolved labels and the text without unknown ones.

    ``answers`` has message_id and content, ``sources`` message_id and label; an answer has few
    sources, so its label list is small.
    """
    known = sources.groupBy("message_id").agg(F.collect_set("label").alias("_known"))
    none = F.array().cast("array<string>")
    joined = (
        answers.join(known, "message_id", "left")
        .withColumn("_known", F.coalesce("_known", none))
        .withColumn("cited", cited_labels(F.col("content")))
    )
    return joined.select(
        "message_id",
        "cited",
        F.size(F.array_intersect("cited", "_known")).alias("resolved"),
        F.size(F.array_except("cited", "_known")).alias("unresolved"),
        keep_known_citations(F.col("content"), F.col("_known")).alias("content"),
    )


def order_evidence(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """Sources of an answer, cited ones first, otherwise by numeric rank."""
    cited = answers.select("message_id", cited_labels(F.col("content")).alias("_cited"))
    per_message = Window.partitionBy("message_id")  # the sources of one answer: at most a dozen
    return (
        sources.join(cited, "message_id")
        .withColumn("cited", F.array_contains("_cited", F.col("label")))
        .withColumn(
            "display_order",
            F.row_number().over(per_message.orderBy(F.desc(F.col("cited").cast("int")), "rank")),
        )
        .withColumn("distinct_files", F.size(F.collect_set("path").over(per_message)))
        .drop("_cited")
    )
