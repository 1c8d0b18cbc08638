"""Registered queries of the Jaccard join and of packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import jaccard, packing
from textquarry.llm.registry import query, table

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS s FROM w),
sized AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM tok a JOIN tok b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON e.x = r.b)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN sized s ON s.doc_id = r.a GROUP BY r.a"""


@query("op1_jaccard_join", OP1_SQL)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


# The same links, counted for each document.
OP1_LINKS_SQL = (
    OP1_SQL[: OP1_SQL.index("\nSELECT r.a")]
    + """,
degrees AS (SELECT x, count(*) AS k FROM both_ways GROUP BY x)
SELECT r.a AS doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, coalesce(any_value(g.k), 0)::BIGINT AS n_links
FROM reach r LEFT JOIN sized s ON s.doc_id = r.a LEFT JOIN degrees g ON g.x = r.a GROUP BY r.a"""
)


@query("op1_jaccard_links", OP1_LINKS_SQL)
def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document and the number of its links, all of them verified."""
    return jaccard.join_links(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)
