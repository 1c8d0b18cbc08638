"""A corpus pipeline: five stages over `documents`, each written as Parquet and read by the next.

1. language_id: documents without a sure language go.
2. near_duplicates: of each component of near copies one row stays, that with the smallest id.
3. substring_dedup: words of spans that start earlier in the corpus are cut out; documents of
   which nothing is left go.
4. source_mix: every document is repeated, cut or left out as the mix takes its blocks. The nth
   copy of a document holds the blocks that are taken n times or more.
5. packing: the token pieces of all documents, placed in sequences.

All but the last return the columns of documents. Stage 2 decides by row, so a doc_id that stands
for two texts loses only the one that is a near copy; rows without a doc_id come after those with
one, there and in stage 3; rows that repeat a doc_id and a text count once in stage 2. An empty
table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import jaccard, langid, mixing, packing, substring
from textquarry.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LANGUAGES = ("de", "en", "es", "fr")
BLOCK_WORDS = 512


def _without(docs: DataFrame, gone: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The documents whose key is not in `gone`; a null key never is."""
    gone = cut_lineage(gone.select(F.col(key).alias("gone_key")).distinct())
    if gone.count() <= most:  # at most 16 MB
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(key) == F.col("gone_key"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = langid.train(docs, LANGUAGES)
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    evidence = keyed.select("row_key", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    # Written first: a filter on the verdict would be pushed into the expressions of the votes.
    found = cut_lineage(langid.identify(evidence, model, LANGUAGES, keys=("row_key",)))
    return _without(keyed, found.filter(~F.coalesce("accepted", F.lit(False))), "row_key").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = jaccard.join_components(keyed.select(F.col("row_key").alias("doc_id"), "text"))
    found = cut_lineage(found.groupBy(F.col("doc_id").alias("row_key"), "component_id").agg(F.count("*").alias("rows")))
    ids = keyed.select(F.col("row_key").alias("k"), "doc_id").distinct()
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    best = found.join(ids, F.col("row_key") == F.col("k")).groupBy("component_id").agg(F.min_by("row_key", first).alias("best"))
    gone = found.join(best, "component_id").filter(F.col("row_key") != F.col("best"))
    kept = _without(keyed, gone, "row_key")
    twice = found.filter("rows > 1")
    repeated = cut_lineage(kept.join(twice.select("row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]))
    return _without(kept, twice, "row_key").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parsed = substring.remove_repeats(docs.select(*COLUMNS), carry=("text", "lang", "source"))
    left = parsed.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    sized = docs.select("row_key", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(sized, key="row_key", block_words=BLOCK_WORDS).filter("taken > 0")
    taken = mixed.groupBy(F.col("row_key").alias("k")).agg(F.collect_list(F.struct("size", "parts")).alias("rows"))
    rows = docs.dropDuplicates(["row_key"]).join(taken, F.col("row_key") == F.col("k")).withColumn("row", F.explode("rows"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max("row.parts.times").cast("int"))))
    parts = F.filter("row.parts", lambda p: p.times >= F.col("copy"))
    copies = copies.withColumn("chosen", parts)
    whole = F.aggregate("chosen", F.lit(0).cast("bigint"), lambda n, p: n + p.words) == F.col("row.size")
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    cut = F.array_join(F.flatten(F.transform("chosen", lambda p: F.slice(words, (p.at + 1).cast("int"), p.words.cast("int")))), " ")
    copies = copies.filter(F.size("chosen") > 0).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return copies.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers outlive the stage; an encoder left in them takes memory from all later ones.
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), remember_bytes=48 << 20, keep=False)
    return packing.pack(pieces)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", best_fit_packing),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
