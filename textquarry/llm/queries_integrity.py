"""Registered queries of the dataset manifest and line deduplication, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import lines, merkle
from textquarry.llm.registry import query, table

#: Every 3 consecutive nodes become their hash, level by level, first per source, then over subroots.
OP11_SQL = r"""
WITH RECURSIVE
fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS bare,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) AS checksum
  FROM documents),
leaves AS (
  SELECT doc_id, source,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS other,
    xor(checksum, 4294967295) % 2 = 0 AS tampered
  FROM fields),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
low AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((size + 2) // 3)
  FROM low WHERE size > 1 GROUP BY tree, level, pos // 3),
subroots AS (SELECT tree, level AS height, h AS subroot FROM low WHERE size = 1),
high AS (
  SELECT 0 AS level, tree AS pos, subroot AS h, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((size + 2) // 3)
  FROM high WHERE size > 1 GROUP BY level, pos // 3),
nodes AS (
  SELECT tree, level, pos, h FROM low WHERE size > 1
  UNION ALL SELECT t.tree, t.height + u.level, u.pos, u.h FROM subroots t, high u WHERE u.size > 1),
steps AS (
  SELECT doc_id, leaf, tree, 0 AS level, pos, '' AS proof, CASE WHEN tampered THEN other ELSE leaf END AS held FROM placed
  UNION ALL
  SELECT s.doc_id, s.leaf, s.tree, s.level + 1, CASE WHEN s.level + 1 = t.height THEN s.tree ELSE s.pos // 3 END,
    s.proof || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> s.pos), ''),
    sha256(string_agg(CASE WHEN n.pos = s.pos THEN s.held ELSE n.h END, '' ORDER BY n.pos))
  FROM steps s JOIN subroots t ON t.tree = s.tree JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.pos // 3 = s.pos // 3
  GROUP BY s.doc_id, s.leaf, s.tree, s.level, s.pos, s.proof, s.held, t.height),
crown AS (SELECT level AS height, h AS root FROM high WHERE size = 1)
SELECT s.doc_id, s.leaf, t.subroot, c.root, sha256(s.proof) AS proof_sha256, s.held AS folded_root, s.held = c.root AS verified
FROM steps s JOIN subroots t ON t.tree = s.tree CROSS JOIN crown c WHERE s.level = t.height + c.height"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and the root that its row, tampered with or not, folds to."""
    key, text = F.col("doc_id"), F.col("text")
    others = [F.col(c) for c in ("source", "lang", "n_chars")]
    tampered = F.crc32(F.encode(key.cast("string"), "UTF-8")) % 2 == 0
    claimed = F.when(F.coalesce(tampered, F.lit(False)), F.translate(text, "\n", "")).otherwise(text)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", merkle.leaf(key, *others, text).alias("leaf"), merkle.leaf(key, *others, claimed).alias("claimed")
    )
    proofs = merkle.build_manifest(rows, group="source", key="doc_id", digest="leaf", carry=["claimed"]).proofs()
    return proofs.select(
        F.col("row.key").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.encode(merkle.joined_path(F.col("path")), "UTF-8"), 256).alias("proof_sha256"),
        merkle.fold(F.col("row.claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, coalesce(holder <> doc_id, false) AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query("op13_line_dedup", OP13_SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the long lines that five or more documents share."""
    cut = lines.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
