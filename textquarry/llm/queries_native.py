"""Registered queries of chat formatting, exact search and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import chat, mixing, topk
from textquarry.llm.registry import query, table

OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + 5 + 8 + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""


@query("op6_reply_trees", OP6_SQL)
def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(quoted).alias("text"),
    )
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    messages = said.select(
        F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("bigint").alias("message_id"), "role", "text"
    ).withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))
    messages = messages.withColumn("score", F.lit(0.0))
    rows = chat.format_paths(chat.reply_paths(messages, best=1), messages)
    turns = chat.read_turns(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.withColumn("turns", turns).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("masked", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


@query("op8_threshold_top_k", OP8_SQL)
def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.filter(F.col("id") % 100 == 0), k=10)


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))
