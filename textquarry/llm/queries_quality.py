"""Registered queries of quality rules, importance resampling and language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import langid, quality
from textquarry.llm.registry import query, table

LANGUAGES = ("de", "en", "es", "fr")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the ratio of trusted to raw text for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_importance_resampling")
def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gumbel top k of all documents by importance weight."""
    return quality.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def documents_evidence(documents: DataFrame) -> DataFrame:
    """Documents declare `lang`; their source takes the place of a host."""
    return documents.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    visible = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1), F.lit(""))
    return pages.select("page_id", visible.alias("text"), declared.alias("declared"), langid.host_of(F.col("url")).alias("host"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is sure enough to keep."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents, LANGUAGES)
    found = langid.identify(documents_evidence(documents), model, LANGUAGES)
    return found.select("doc_id", "language", "posterior", "n_grams", F.col("accepted").alias("kept"))


@query("language_id_pages")
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages, with markup language, address suffix and host."""
    model = langid.train(table(spark, sf_dir, "documents"), LANGUAGES)
    found = langid.identify(pages_evidence(table(spark, sf_dir, "pages")), model, LANGUAGES, keys=("page_id",))
    return found.select("page_id", "language", "posterior", "n_grams", F.col("accepted").alias("kept"))
