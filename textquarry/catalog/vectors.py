"""Embedding text, reuse, batching and nearest neighbours."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textquarry.catalog import search_sql as sql
from textquarry.catalog.base import CHUNKS_SQL, CORPUS_FILES_SQL, corpus_index, document_chunks, query, table, with_ctes
from textquarry.catalog.terms import CORPUS_SQL, SEARCHED_SQL, benchmark_queries
from textquarry.functions import vectors as vector_functions
from textquarry.operators import lexical, vector_index, vectors
from textquarry.plans import index as plan
from textquarry.plans import search
from textquarry.session import checkpoint_dir
from textquarry.sources import sinks

WIDTH = 64
TOP = 10

EMBEDDED_TEXT_SQL = f"""embedded AS (
  SELECT *, 'Repository: ' || repository_id || chr(10) || 'Path: ' || path || chr(10) || 'Language: ' || language || chr(10)
      || 'Kind: ' || chunk_type || chr(10) || chr(10) || content AS embedding_text FROM chunks)"""


def chunk_texts(spark, sf_dir):
    bare = document_chunks(spark, sf_dir)
    return vectors.content_hash(vectors.embedding_text(bare))


@query(
    "embedding_text",
    with_ctes(CORPUS_FILES_SQL, CHUNKS_SQL, EMBEDDED_TEXT_SQL,
              select="SELECT chunk_id, length(embedding_text) AS chars, md5(embedding_text) AS text_md5 FROM embedded"),
)
def embedding_text(spark, sf_dir):
    return chunk_texts(spark, sf_dir).select(
        "chunk_id", F.length("embedding_text").alias("chars"), F.md5("embedding_text").alias("text_md5")
    )


@query(
    "content_hash",
    with_ctes(CORPUS_FILES_SQL, CHUNKS_SQL, EMBEDDED_TEXT_SQL,
              select="SELECT chunk_id, sha256(embedding_text) AS content_hash FROM embedded"),
)
def content_hash(spark, sf_dir):
    return chunk_texts(spark, sf_dir).select("chunk_id", "content_hash")


# Earlier vectors: one per test vector id, stored for the text of the document with that id.
PREVIOUS_SQL = """previous AS (
  SELECT 'corpus' AS repository_id, e.vec_id::VARCHAR AS chunk_id, sha256(d.text) AS content_hash,
         CASE WHEN label = 0 THEN NULL ELSE 'hosted' END AS provider, 'm' || (label % 3) AS model, 64 AS dimensions, e.embedding
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""


@query(
    "reuse_embeddings",
    with_ctes(
        PREVIOUS_SQL,
        select="""SELECT doc_id, p.first_id IS NOT NULL AS reused, coalesce(p.first_id, '') AS source_vector
                  FROM documents d LEFT JOIN (
                    SELECT content_hash, min(chunk_id) AS first_id FROM previous WHERE provider = 'hosted' AND model = 'm1' GROUP BY 1) p
                  ON p.content_hash = sha256(d.text)""",
    ),
)
def reuse_embeddings(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("corpus").alias("repository_id"), F.sha2("text", 256).alias("content_hash")
    )
    label = F.col("label")
    previous = (
        table(spark, sf_dir, "embeddings")
        .join(documents, F.col("doc_id") == F.col("vec_id"))
        .select(
            "repository_id", "content_hash", F.col("vec_id").cast("string").alias("chunk_id"),
            F.when(label != 0, "hosted").alias("provider"), F.concat(F.lit("m"), (label % 3).cast("string")).alias("model"),
            F.lit(WIDTH).alias("dimensions"), F.struct(F.col("vec_id").cast("string").alias("id"), "embedding").alias("embedding"),
        )
    )
    out = vectors.reuse_embeddings(documents, previous, "hosted", "m1", WIDTH)
    return out.select("doc_id", "reused", F.coalesce("embedding.id", F.lit("")).alias("source_vector"))


@query(
    "pack_batches",
    with_ctes(
        CORPUS_FILES_SQL, CHUNKS_SQL, EMBEDDED_TEXT_SQL,
        """lengths AS (
  SELECT chunk_id, length(embedding_text) AS chars, ('0x' || left(md5(chunk_id), 8))::BIGINT
           % ceil((SELECT count(*) FROM embedded) / 512)::BIGINT AS batch_group FROM embedded),
numbered AS (SELECT *, row_number() OVER (PARTITION BY batch_group ORDER BY chunk_id) AS n FROM lengths),
packed AS (
  SELECT batch_group, n, 0 AS batch_id, 1 AS items, chars, chunk_id FROM numbered WHERE n = 1
  UNION ALL
  SELECT l.batch_group, l.n, CASE WHEN p.items >= 64 OR p.chars + l.chars > 30000 THEN p.batch_id + 1 ELSE p.batch_id END,
         CASE WHEN p.items >= 64 OR p.chars + l.chars > 30000 THEN 1 ELSE p.items + 1 END,
         CASE WHEN p.items >= 64 OR p.chars + l.chars > 30000 THEN l.chars ELSE p.chars + l.chars END, l.chunk_id
  FROM packed p JOIN numbered l ON l.batch_group = p.batch_group AND l.n = p.n + 1)""",
        select="SELECT chunk_id, batch_group, batch_id FROM packed",
    ),
)
def pack_batches(spark, sf_dir):
    """The embedding request of every chunk."""
    texts = chunk_texts(spark, sf_dir).select("repository_id", "chunk_id", "embedding_text")
    packed = vectors.pack_batches(texts, max_chars=30_000, group_rows=512)
    return packed.select("chunk_id", "batch_group", "batch_id")


def letter_embedder(texts: pd.Series, kind: str) -> np.ndarray:
    """A tiny embedder for the contract: share of each letter."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    letters = [re.sub("[^a-z]", "", text.lower()) for text in texts]
    return np.array([[word.count(a) / max(len(word), 1) for a in alphabet] for word in letters])


# Digests of whole vectors, value by value as whole numbers of the last digit kept.
EMBED_SQL = with_ctes(
        CORPUS_FILES_SQL, CHUNKS_SQL,
        select="""SELECT chunk_id, md5(array_to_string(list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '),
                         lambda a: round((length(s) - length(replace(s, a, '')))::DOUBLE / greatest(length(s), 1) * 1000000)::BIGINT), ' ')) AS vector_md5
                  FROM (SELECT chunk_id, regexp_replace(lower(content), '[^a-z]', '', 'g') AS s FROM chunks)""",
    )


@query("embed", EMBED_SQL)
@query("embed_whole", EMBED_SQL)
def embed(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir).select("chunk_id", "content")
    out = vectors.embed(chunks, letter_embedder, "document", 26, text_col="content")
    return out.select("chunk_id", vector_digest(F.col("embedding"), 1_000_000))


def vector_digest(vector, scale: int):
    values = F.transform(vector, lambda v: F.round(v.cast("double") * scale).cast("bigint").cast("string"))
    return F.md5(F.array_join(values, " ")).alias("vector_md5")


HASHED_EMBEDDINGS_SQL = with_ctes(
        *CORPUS_SQL, sql.CHUNK_SLOTS_SQL,
        f"""filled AS (SELECT s.chunk_id, slot, v / size AS v FROM c_slots s JOIN c_norms n USING (chunk_id) WHERE size > 0),
slots AS (SELECT chunk_id, unnest(range({plan.DIMENSIONS})) AS slot FROM (SELECT DISTINCT chunk_id FROM filled))""",
        select="""SELECT chunk_id, md5(string_agg(round(coalesce(v, 0) * 100000)::BIGINT, ' ' ORDER BY slot)) AS vector_md5
                  FROM slots LEFT JOIN filled USING (chunk_id, slot) GROUP BY chunk_id""",
    )


@query("hashed_embeddings", HASHED_EMBEDDINGS_SQL)
@query("hashed_embeddings_whole", HASHED_EMBEDDINGS_SQL)
def hashed_embeddings(spark, sf_dir):
    made = plan.chunk_vectors(lexical.build_postings(document_chunks(spark, sf_dir)))
    return made.select("chunk_id", vector_digest(F.col("embedding"), 100_000))


L2_NORMALISE_SQL = """SELECT vec_id, md5(array_to_string(list_transform(embedding, lambda v: round(v::DOUBLE / size * 1000000)::BIGINT), ' ')) AS vector_md5
       FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS size FROM embeddings)"""


@query("l2_normalise", L2_NORMALISE_SQL)
@query("l2_normalise_whole", L2_NORMALISE_SQL)
def l2_normalise(spark, sf_dir):
    unit = vectors.l2_normalise(table(spark, sf_dir, "embeddings"))
    return unit.select("vec_id", vector_digest(F.col("embedding"), 1_000_000))


@query(
    "validate_vectors",
    """SELECT vec_id, CASE WHEN label = 3 THEN 'wrong_width' ELSE 'other_model' END AS reason
       FROM embeddings WHERE label = 3 OR label % 2 = 1""",
)
def validate_vectors(spark, sf_dir):
    """Vectors of one label are cut short, odd labels belong to another model."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
        F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"),
    )
    return vectors.validate_vectors(rows, WIDTH, "m0").select("vec_id", "reason")


def labelled(spark, sf_dir):
    """All vectors as one corpus, and the centre of each label as a query."""
    rows = table(spark, sf_dir, "embeddings")
    repository = F.lit("vectors").alias("repository_id")
    corpus = rows.select(F.col("vec_id").cast("string").alias("chunk_id"), repository, "embedding")
    centres = (
        rows.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("embedding"))
        .select(F.col("label").cast("string").alias("query_id"), repository, "embedding")
    )
    return centres, corpus


LABELLED_SQL = """entries AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings),
centres AS (SELECT label, i, avg(v) AS v FROM entries GROUP BY label, i),
centre_norms AS (SELECT label, sqrt(sum(v * v)) AS size FROM centres GROUP BY label),
vector_norms AS (SELECT vec_id, sqrt(sum(v * v)) AS size FROM entries GROUP BY vec_id),
cosines AS (
  SELECT c.label AS query_id, e.vec_id, round(sum(c.v * e.v) / (any_value(cn.size) * any_value(vn.size)), 9) AS score
  FROM centres c JOIN entries e USING (i) JOIN centre_norms cn ON cn.label = c.label JOIN vector_norms vn ON vn.vec_id = e.vec_id
  GROUP BY c.label, e.vec_id),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS semantic_rank FROM cosines
  QUALIFY semantic_rank <= 10)"""


@query(
    "cosine_top_k",
    with_ctes(LABELLED_SQL, select="SELECT query_id, vec_id, semantic_rank, score FROM nearest"),
)
def cosine_top_k(spark, sf_dir):
    centres, corpus = labelled(spark, sf_dir)
    return vectors.cosine_top_k(centres, corpus, TOP).select(
        F.col("query_id").cast("bigint").alias("query_id"), F.col("chunk_id").cast("bigint").alias("vec_id"),
        "semantic_rank", F.col("score"),
    )


@query(
    "cosine_of_label_centres",
    with_ctes(
        LABELLED_SQL,
        select="SELECT vec_id, score FROM cosines c JOIN embeddings e USING (vec_id) WHERE c.query_id = e.label",
    ),
)
def cosine_of_label_centres(spark, sf_dir):
    """Every vector against the centre of its own label, in native columns."""
    centres, _ = labelled(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").withColumn("query_id", F.col("label").cast("string"))
    joined = rows.join(centres.withColumnRenamed("embedding", "centre"), "query_id")
    return joined.select(
        "vec_id", F.round(vector_functions.cosine(F.col("embedding"), F.col("centre")), 9).alias("score")
    )


@query("ann_top_k")
def ann_top_k(spark, sf_dir):
    """Recall of the approximate search against the exact one, per label centre."""
    centres, corpus = labelled(spark, sf_dir)
    approximate = vectors.ann_top_k(centres, corpus, TOP, WIDTH)
    return vectors.recall(approximate, vectors.cosine_top_k(centres, corpus, TOP))


@query(
    "similarity_for_pairs",
    with_ctes(
        *SEARCHED_SQL, sql.SEMANTIC_SQL,
        select="""SELECT l.query_id, l.chunk_id, x.score FROM covered l
                  JOIN sims x ON x.query_id = l.query_id AND x.chunk_id = l.chunk_id
                  WHERE NOT EXISTS (SELECT 1 FROM semantic s WHERE s.query_id = l.query_id AND s.chunk_id = l.chunk_id)""",
    ),
)
def similarity_for_pairs(spark, sf_dir):
    """Scores of lexical hits outside the semantic pool."""
    index, queries = corpus_index(spark, sf_dir), benchmark_queries(spark, sf_dir)
    asked = lexical.query_terms(queries)
    stats = lexical.term_statistics(index.postings, index.chunks, asked)
    hits = lexical.lexical_search(index.postings, stats, asked, 40).withColumn("query_id", F.col("query_id").cast("string"))
    vectors_of = plan.query_vectors(queries).withColumn("query_id", F.col("query_id").cast("string"))
    semantic = vectors.cosine_top_k(vectors_of, index.embeddings, 40)
    extra = vectors.outside_pool_similarity(hits, semantic, vectors_of, index.embeddings)
    return extra.select(F.col("query_id").cast("bigint").alias("query_id"), "chunk_id", F.col("score"))


@query(
    "embedding_counts",
    """SELECT 'label' || label AS repository_id, 'm' || (vec_id % 2) AS model, count(*) AS embeddings, true AS searchable
       FROM embeddings GROUP BY ALL""",
)
def embedding_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("repository_id"),
        F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), "embedding",
    )
    return vectors.embedding_counts(rows)


@query("ivf_top_k")
def ivf_top_k(spark, sf_dir):
    """Recall of the inverted file against the exact search, for every hundredth vector, and the share of codes read."""
    rows = table(spark, sf_dir, "embeddings")
    corpus = rows.select(F.lit("vectors").alias("repository_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    asked = corpus.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    plan.write_cells(path, "first", corpus, WIDTH)
    index = vector_index.VectorIndex(sinks.read_table(spark, f"{path}/cells").drop("run"), spark.read.parquet(f"{path}/cell_model"))
    found = vectors.recall(vector_index.ivf_top_k(asked, index, corpus, TOP), vectors.cosine_top_k(asked, corpus, TOP))
    return found.join(vector_index.read_share(asked, index), "query_id")


@query(
    "refused_queries",
    """SELECT 'q' || label AS query_id, 'label' || label AS repository_id, CASE WHEN label = 99 THEN 'no_embeddings' ELSE 'other_model' END AS reason
       FROM (SELECT label FROM embeddings WHERE label % 2 = 1 OR label = 4 UNION SELECT 99) WHERE label % 2 = 1 OR label = 4""",
)
def refused_queries(spark, sf_dir):
    """Repositories of odd labels were embedded with another model, one with another width, one not at all."""
    label = F.col("label")
    rows = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), label.cast("string")).alias("repository_id"), F.lit("hosted").alias("provider"),
        F.concat(F.lit("m"), (label % 2).cast("string")).alias("model"), F.when(label == 4, 32).otherwise(WIDTH).alias("dimensions"), "embedding", "label",
    )
    asked = rows.select("label").distinct().unionByName(spark.range(99, 100).select(F.col("id").cast("int").alias("label")))
    queries = asked.select(F.concat(F.lit("q"), label.cast("string")).alias("query_id"), F.concat(F.lit("label"), label.cast("string")).alias("repository_id"))
    return search.refused_queries(queries, rows, "hosted", "m0", WIDTH)
