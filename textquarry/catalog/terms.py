"""Tokenisation, inverted index and full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog import lexical_sql as sql
from textquarry.catalog.base import (
    CHUNKS_SQL,
    CORPUS,
    CORPUS_FILES_SQL,
    corpus_blocks,
    corpus_index,
    document_chunks,
    query,
    table,
    with_ctes,
)
from textquarry.functions import terms
from textquarry.operators import lexical, lexical_index
from textquarry.session import cut_lineage

# Every benchmark passage is a question; it also names one document, as a question about a
# known file would.
QUERIES_SQL = f"""queries AS (
  SELECT item_id AS query_id, '{CORPUS}' AS repository_id, text || ' see en/' || item_id || '.txt' AS text FROM benchmark)"""


def benchmark_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit(CORPUS).alias("repository_id"),
        F.concat(F.col("text"), F.lit(" see en/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("text"),
    )


CORPUS_SQL = (CORPUS_FILES_SQL, CHUNKS_SQL, sql.POSTINGS_SQL)
ASKED_SQL = (*CORPUS_SQL, QUERIES_SQL, sql.QUERY_TERMS_SQL, sql.STATS_SQL)
SEARCHED_SQL = (*ASKED_SQL, sql.LEXICAL_SQL)

# Identifier-like words: every word of a text and the word after it, joined in the usual program styles.
STYLED_WHOLE_SQL = """words AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM documents),
neighbours AS (SELECT doc_id, nth, ws[nth] AS w1, coalesce(ws[nth + 1], '') AS w2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS nth FROM words)),
styled AS (
  SELECT doc_id, nth, unnest([w1 || '_' || w2, w1 || upper(w2[1:1]) || w2[2:], upper(w1) || upper(w2[1:1]) || lower(w2[2:]),
                             '$' || w1 || doc_id || w2, w1]) AS word, unnest([1, 2, 3, 4, 5]) AS form FROM neighbours)"""


IDENTIFIER_TERMS_SQL = with_ctes(
    STYLED_WHOLE_SQL,
    select=f"""SELECT doc_id, form, count(*) AS words, md5(string_agg(array_to_string({sql.terms_of('word')}, ' '), '|' ORDER BY nth)) AS terms_md5
                   FROM styled GROUP BY doc_id, form""",
)


@query("identifier_terms", IDENTIFIER_TERMS_SQL)
@query("identifier_terms_whole", IDENTIFIER_TERMS_SQL)
def identifier_terms(spark, sf_dir):
    """The terms of all neighbouring words of every text, in the five styles, as a digest."""
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    documents = table(spark, sf_dir, "documents").repartition("doc_id")
    rows = documents.where(F.col("text").rlike("[A-Za-z]")).select("doc_id", found.alias("ws"))
    after = F.concat(F.slice("ws", F.lit(2), F.size("ws")), F.array(F.lit("")))
    head, tail = lambda w: F.upper(F.substring(w, 1, 1)), lambda w: F.substr(w, F.lit(2))
    number = F.col("doc_id").cast("string")
    styles = (
        lambda a, b: F.concat(a, F.lit("_"), b),
        lambda a, b: F.concat(a, head(b), tail(b)),
        lambda a, b: F.concat(F.upper(a), head(b), F.lower(tail(b))),
        lambda a, b: F.concat(F.lit("$"), a, number, b),
        lambda a, b: a,
    )
    styled = F.posexplode(F.array(*(F.zip_with("ws", after, style) for style in styles))).alias("_n", "styled")
    rows = rows.select("doc_id", F.size("ws").cast("bigint").alias("words"), styled)
    rows = rows.withColumn("terms_md5", F.md5(F.array_join(terms.joined_terms("styled"), "|")))
    return rows.select("doc_id", (F.col("_n") + 1).alias("form"), "words", "terms_md5")


@query(
    "text_terms",
    with_ctes(
        *CORPUS_SQL,
        select="""SELECT chunk_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms,
                         md5(string_agg(term, ' ' ORDER BY term)) AS terms_md5
                  FROM chunk_term_rows WHERE is_name = 0 GROUP BY chunk_id""",
    ),
)
def text_terms(spark, sf_dir):
    found = document_chunks(spark, sf_dir).select("chunk_id", terms.text_terms(F.col("content")).alias("t"))
    return found.where(F.size("t") > 0).select(
        "chunk_id", F.size("t").alias("terms"), F.size(F.array_distinct("t")).alias("distinct_terms"),
        F.md5(F.array_join(F.array_sort("t"), " ")).alias("terms_md5"),
    )


@query(
    "lexical_fields",
    with_ctes(
        *CORPUS_SQL,
        select="""SELECT chunk_id, count(*) FILTER (WHERE is_name = 1) AS name_terms,
                         count(*) FILTER (WHERE is_name = 0) AS body_terms FROM chunk_term_rows GROUP BY chunk_id""",
    ),
)
def lexical_fields(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir)
    return lexical.lexical_fields(chunks).select(
        "chunk_id", F.size("names").alias("name_terms"), F.size("body").alias("body_terms")
    )


@query(
    "query_terms",
    with_ctes(QUERIES_SQL, sql.QUERY_TERMS_SQL, select="SELECT query_id, position, term FROM query_terms"),
)
def query_terms(spark, sf_dir):
    return lexical.query_terms(benchmark_queries(spark, sf_dir)).select("query_id", "position", "term")


@query(
    "query_identifiers",
    with_ctes(
        QUERIES_SQL.replace("FROM benchmark", "FROM benchmark UNION ALL SELECT page_id + 1000000, 'corpus', url || ' ' || html FROM pages"),
        sql.QUERY_TERMS_SQL,
        select="SELECT q.query_id, coalesce(array_to_string(identifiers, ' '), '') AS identifiers FROM queries q LEFT JOIN identifiers USING (query_id)",
    ),
)
def query_identifiers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1_000_000).alias("query_id"), F.lit(CORPUS).alias("repository_id"),
        F.concat_ws(" ", "url", "html").alias("text"),
    )
    asked = benchmark_queries(spark, sf_dir).unionByName(pages)
    return lexical.query_identifiers(asked).select("query_id", F.array_join("identifiers", " ").alias("identifiers"))


@query(
    "build_postings",
    with_ctes(*CORPUS_SQL, select="SELECT term, chunk_id, tf_names, tf_body, chunk_terms FROM postings"),
)
def build_postings(spark, sf_dir):
    postings = lexical.build_postings(document_chunks(spark, sf_dir))
    return postings.select("term", "chunk_id", "tf_names", "tf_body", "chunk_terms")


def asked(spark, sf_dir):
    index = corpus_index(spark, sf_dir)
    rows = lexical.query_terms(benchmark_queries(spark, sf_dir))
    return index.postings, rows, lexical.term_statistics(index.postings, index.chunks, rows)


@query(
    "term_statistics",
    with_ctes(*ASKED_SQL, select="SELECT term, total_chunks, df FROM stats"),
)
def term_statistics(spark, sf_dir):
    return asked(spark, sf_dir)[2].select("term", "total_chunks", "df")


@query("idf", with_ctes(*ASKED_SQL, select="SELECT term, round(idf, 6) AS idf, informative FROM stats"))
def idf(spark, sf_dir):
    return asked(spark, sf_dir)[2].select("term", F.round("idf", 6).alias("idf"), "informative")


@query(
    "lexical_search",
    with_ctes(
        *SEARCHED_SQL,
        select="SELECT query_id, chunk_id, text_rank, text_position, matched_terms FROM lexical_hits",
    ),
)
def lexical_search(spark, sf_dir):
    postings, rows, stats = asked(spark, sf_dir)
    return lexical.lexical_search(postings, stats, rows, sql.LEXICAL_LIMIT).select(
        "query_id", "chunk_id", F.col("text_rank"), "text_position",
        F.array_join("matched_terms", " ").alias("matched_terms"),
    )


@query(
    "coverage",
    with_ctes(*SEARCHED_SQL, select="SELECT query_id, chunk_id, coverage FROM covered"),
)
def coverage(spark, sf_dir):
    postings, rows, stats = asked(spark, sf_dir)
    hits = lexical.lexical_search(postings, stats, rows, sql.LEXICAL_LIMIT)
    return lexical.coverage(hits, stats, rows).select("query_id", "chunk_id", F.col("coverage"))


def block_asked(spark, sf_dir):
    index = corpus_blocks(spark, sf_dir)  # a table of it is written when it is asked for
    rows = lexical.query_terms(benchmark_queries(spark, sf_dir))
    return index, rows, lexical_index.stored_statistics(index, rows)


@query(
    "stored_statistics",
    with_ctes(*ASKED_SQL, select="SELECT term, total_chunks, df, round(idf, 6) AS idf, informative FROM stats"),
)
def stored_statistics(spark, sf_dir):
    return block_asked(spark, sf_dir)[2].select("term", "total_chunks", "df", F.round("idf", 6).alias("idf"), "informative")


@query(
    "block_search",
    with_ctes(
        *SEARCHED_SQL,
        select="SELECT query_id, chunk_id, text_rank, text_position, matched_terms FROM lexical_hits",
    ),
)
def block_search(spark, sf_dir):
    index, rows, stats = block_asked(spark, sf_dir)
    return lexical_index.block_search(index, stats, rows, sql.LEXICAL_LIMIT).select(
        "query_id", "chunk_id", "text_rank", "text_position", F.array_join("matched_terms", " ").alias("matched_terms")
    )


@query(
    "segment_bounds",
    with_ctes(
        *SEARCHED_SQL,
        select="""SELECT query_id, count(*) AS chunks, max(text_rank) AS best FROM matches GROUP BY query_id""",
    ),
)
def segment_bounds(spark, sf_dir):
    """What the bounds of all segments promise: none lies below a rank in it, so no chunk is lost."""
    index, rows, stats = block_asked(spark, sf_dir)
    searchable = lexical.searchable_terms(stats, rows).withColumn("bucket", lexical_index.term_bucket(F.col("term")))
    return lexical_index.chunks_within_bounds(index, cut_lineage(searchable))
