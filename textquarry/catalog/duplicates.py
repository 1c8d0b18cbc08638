"""Near-duplicates over all chunks of the documents."""

from __future__ import annotations

from textquarry.catalog.base import CHUNKS_SQL, CORPUS_FILES_SQL, document_chunks, query, with_ctes
from textquarry.operators import near_duplicates

# Distinct tokens that a chunk needs, and the similarity that makes a link.
LINKS_SQL = """token_sets AS (
  SELECT chunk_id, list_distinct(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS toks FROM chunks),
sized AS (SELECT chunk_id, toks, len(toks) AS n FROM token_sets),
pairs AS (
  SELECT a.chunk_id AS a, b.chunk_id AS b, a.n + b.n AS together, len(list_intersect(a.toks, b.toks)) AS shared FROM sized a JOIN sized b
    ON a.chunk_id < b.chunk_id AND a.n >= 12 AND b.n >= 12 AND b.n BETWEEN 0.9 * a.n AND a.n / 0.9 + 1),
alike AS MATERIALIZED (SELECT a, b FROM pairs WHERE shared >= 0.9 * (together - shared)),
links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reached AS (
  SELECT chunk_id AS a, chunk_id AS b FROM sized
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS chunk_id, min(b) AS class_id FROM reached GROUP BY a),
degrees AS (SELECT a AS chunk_id, count(*) AS n_links FROM links GROUP BY a)"""


@query(
    "corpus_near_duplicates",
    with_ctes(
        CORPUS_FILES_SQL, CHUNKS_SQL, LINKS_SQL,
        select="""SELECT chunk_id, n AS n_tokens, class_id, coalesce(n_links, 0) AS n_links
                  FROM sized JOIN classes USING (chunk_id) LEFT JOIN degrees USING (chunk_id)""",
    ),
)
def corpus_near_duplicates(spark, sf_dir):
    """Chunks are cut as their tokens are taken; they are needed once, so none are stored."""
    return near_duplicates.corpus_near_duplicates(document_chunks(spark, sf_dir))
