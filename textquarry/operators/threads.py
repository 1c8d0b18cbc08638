"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """Last n turns per conversation with their place in replay order, oldest first.

    The rank limit is applied before the shuffle, so a very long thread sends n rows per task.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    oldest = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    recent = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n)
    return recent.withColumn("replay_order", F.row_number().over(oldest)).drop("_back")


def list_messages(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Turns with their citations nested in rank order (an answer cites at most a dozen)."""
    nested = citations.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "label", "path", "start_line", "end_line"))).alias("citations")
    )
    return messages.join(nested, "message_id", "left")


def list_conversations(conversations: DataFrame, messages: DataFrame, limit: int = 30) -> DataFrame:
    """Newest threads per repository, leaving out those without a message."""
    order = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), "conversation_id")
    return (
        conversations.join(messages.select("conversation_id").distinct(), "conversation_id", "left_semi")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )


def surviving_citations(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """A citation outlives its chunk: the id becomes null, the copied location stays."""
    alive = chunks.select("chunk_id", F.lit(True).alias("_alive"))
    return (
        citations.join(alive, "chunk_id", "left")
        .withColumn("chunk_id", F.when(F.col("_alive"), F.col("chunk_id")))
        .drop("_alive")
    )


def answer_metrics(answers: DataFrame) -> DataFrame:
    """Answers per repository and model: sources, strength mix, latency, context use, tokens.

    The median is exact: it counts values, not rows, and latencies are whole milliseconds.
    """
    return answers.groupBy("repository_id", "model").agg(
        F.count("*").alias("answers"),
        F.sum("sources").alias("sources"),
        F.count_if(F.col("strength") == "useful").alias("useful"),
        F.count_if(F.col("strength") == "weak").alias("weak"),
        F.count_if(F.col("strength") == "none").alias("without_evidence"),
        F.min("latency_ms").alias("latency_min"),
        F.percentile("latency_ms", 0.5).alias("latency_median"),
        F.max("latency_ms").alias("latency_max"),
        F.round(F.try_divide(F.sum("context_chars"), F.sum("context_budget")), 6).alias("context_use"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    )
