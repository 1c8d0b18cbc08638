"""Sources, filters and preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog.base import (
    FILES_SQL,
    MANIFEST_SQL,
    document_files,
    manifest,
    query,
    table,
    with_ctes,
)
from textquarry.functions import paths
from textquarry.operators import filters
from textquarry.settings import IndexLimits
from textquarry.sources import files as source_files
from textquarry.sources import sinks

SIZE_LIMIT = IndexLimits(max_file_bytes=512_000)
BUDGET = IndexLimits(max_total_bytes=9_000_000, max_files=45)


@query("documents_as_files", with_ctes(FILES_SQL, select="SELECT repository_id, path, sha, size, pos FROM files"))
def documents_as_files(spark, sf_dir):
    files = source_files.documents_as_files(table(spark, sf_dir, "documents"))
    return files.select("repository_id", "path", "sha", "size", "pos")


@query(
    "pages_as_files",
    """SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repository_id,
              'pages/' || page_id || '.html' AS path, sha256(html) AS sha, strlen(html) AS size FROM pages""",
)
def pages_as_files(spark, sf_dir):
    return source_files.pages_as_files(table(spark, sf_dir, "pages")).select("repository_id", "path", "sha", "size")


@query(
    "conversations_as_messages",
    """SELECT conv_id AS conversation_id, conv_id || '-' || turn AS message_id, role,
              length(text) AS chars, (epoch(TIMESTAMP '2024-01-01') + turn * 60)::BIGINT AS created
       FROM conversations""",
)
def conversations_as_messages(spark, sf_dir):
    messages = source_files.conversations_as_messages(table(spark, sf_dir, "conversations"))
    return messages.select(
        "conversation_id", "message_id", "role", F.length("content").alias("chars"),
        F.unix_timestamp("created_at").alias("created"),
    )


def tree_nodes(spark, sf_dir):
    """Regions hold nations, nations hold customers; one market segment stands for submodules."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    tag = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    repository = F.lit("world").alias("repository_id")
    return (
        region.select(
            repository, F.lit(None).cast("string").alias("parent_sha"), F.col("r_name").alias("name"),
            tag("r", "r_regionkey").alias("sha"), F.lit("tree").alias("type"),
        )
        .unionByName(
            nation.select(
                repository, tag("r", "n_regionkey").alias("parent_sha"), F.col("n_name").alias("name"),
                tag("n", "n_nationkey").alias("sha"), F.lit("tree").alias("type"),
            )
        )
        .unionByName(
            customer.select(
                repository, tag("n", "c_nationkey").alias("parent_sha"), F.col("c_name").alias("name"),
                tag("c", "c_custkey").alias("sha"),
                F.when(F.col("c_mktsegment") == "MACHINERY", "commit").otherwise("blob").alias("type"),
            )
        )
    )


@query(
    "rebuild_paths",
    """SELECT r_name || '/' || n_name || '/' || c_name AS path, 'c' || c_custkey AS sha
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE c_mktsegment <> 'MACHINERY'""",
)
def rebuild_paths(spark, sf_dir):
    return source_files.rebuild_paths(tree_nodes(spark, sf_dir)).select("path", "sha")


@query(
    "attach_content",
    with_ctes(
        FILES_SQL,
        select="""SELECT path, CASE WHEN path NOT LIKE 'de/%' THEN md5(content) END AS content_md5,
                         CASE WHEN path LIKE 'de/%' THEN 'decode_failed' END AS skip_reason FROM files""",
    ),
)
def attach_content(spark, sf_dir):
    """German blobs are missing, French ones come as base64."""
    documents = table(spark, sf_dir, "documents")
    files = source_files.documents_as_files(documents)
    french = F.col("lang") == "fr"
    blobs = (
        documents.where("lang <> 'de'")
        .select(
            F.sha2("text", 256).alias("sha"),
            F.when(french, "base64").otherwise("utf-8").alias("encoding"),
            F.when(french, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text")).alias("payload"),
        )
        .groupBy("sha")
        .agg(F.any_value("encoding").alias("encoding"), F.any_value("payload").alias("payload"))
    )
    german = files.where(F.col("path").startswith("de/")).withColumn("sha", F.concat(F.lit("missing"), "sha"))
    listed = files.where(~F.col("path").startswith("de/")).unionByName(german).drop("content")
    return source_files.attach_content(listed, blobs).select(
        "path", F.md5("content").alias("content_md5"), "skip_reason"
    )


@query(
    "upsert",
    """WITH newest AS (
         SELECT o_custkey * 2 AS k, arg_max(o_totalprice, o_orderkey) AS balance,
                arg_max(o_orderpriority, o_orderkey) AS segment FROM orders GROUP BY 1)
       SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, '') AS c_name,
              coalesce(balance, c_acctbal) AS c_acctbal, coalesce(segment, c_mktsegment) AS c_mktsegment
       FROM customer FULL JOIN newest ON c_custkey = k""",
)
def upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").drop("c_nationkey")
    updates = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"),
        F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey",
    )
    return sinks.upsert(base, updates, ["c_custkey"], "o_orderkey").withColumn(
        "c_name", F.coalesce("c_name", F.lit(""))
    )


# ---- filters -----------------------------------------------------------------

LANGUAGE_SQL = (
    "languages AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{s}', '{c}', {str(p).lower()}, '{k}')" for s, c, p, k in paths.language_rows())
    + ") v(language, content_type, parseable, k)),\n"
    """typed AS (
  SELECT m.*, l.language, l.content_type, l.parseable FROM (
    SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name,
           CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^.+[.][^.]+$')
                THEN regexp_extract(lower(regexp_extract(path, '[^/]*$')), '[.][^.]+$')
                WHEN lower(regexp_extract(path, '[^/]*$')) NOT LIKE '.%'
                THEN lower(regexp_extract(path, '[^/]*$')) END AS k FROM manifest) m
  LEFT JOIN languages l USING (k))"""
)
REASON_SQL = """excluded AS (
  SELECT *, CASE
      WHEN len(list_intersect(string_split(lower(path), '/')[:-2], {dirs})) > 0 THEN 'excluded_directory'
      WHEN name IN ({names}) OR name LIKE '%.min.js' OR name LIKE '%.min.css' OR name LIKE '%.bundle.js'
        OR name LIKE '%.map' OR name LIKE '%.lock' THEN 'excluded_file' END AS path_reason FROM typed),
judged AS (
  SELECT *, CASE WHEN type = 'commit' THEN 'submodule' WHEN type <> 'blob' THEN 'unsupported_type'
      WHEN path_reason IS NOT NULL THEN path_reason WHEN language IS NULL THEN 'unsupported_type'
      WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN size > 512000 THEN 'too_large' END AS skip_reason
  FROM excluded)""".format(
    dirs="[" + ", ".join(f"'{d}'" for d in paths.EXCLUDED_DIRECTORIES) + "]",
    names=", ".join(f"'{n}'" for n in paths.EXCLUDED_NAMES),
)
JUDGED = (MANIFEST_SQL, LANGUAGE_SQL, REASON_SQL)


@query(
    "detect_language",
    with_ctes(MANIFEST_SQL, LANGUAGE_SQL, select="SELECT path, language, content_type, parseable FROM typed"),
)
def detect_language(spark, sf_dir):
    return filters.detect_language(manifest(spark, sf_dir)).select("path", "language", "content_type", "parseable")


@query("path_skip_reason", with_ctes(*JUDGED, select="SELECT path, path_reason AS skip_reason FROM excluded"))
def path_skip_reason(spark, sf_dir):
    return manifest(spark, sf_dir).select("path", paths.exclusion_reason(F.col("path")).alias("skip_reason"))


@query("metadata_decision", with_ctes(*JUDGED, select="SELECT path, skip_reason FROM judged"))
def metadata_decision(spark, sf_dir):
    return filters.metadata_decision(manifest(spark, sf_dir), SIZE_LIMIT).select("path", "skip_reason")


BUDGET_SQL = f"""accepted AS (
  SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY pos) AS n FROM judged WHERE skip_reason IS NULL),
budget AS (
  SELECT repository_id, 0::BIGINT AS n, 0::BIGINT AS pos, '' AS path, {BUDGET.max_total_bytes}::BIGINT AS remaining,
         0 AS files, NULL::VARCHAR AS reason FROM accepted GROUP BY repository_id
  UNION ALL
  SELECT a.repository_id, a.n, a.pos, a.path,
    CASE WHEN b.files < {BUDGET.max_files} AND a.size <= b.remaining THEN b.remaining - a.size ELSE b.remaining END,
    CASE WHEN b.files < {BUDGET.max_files} AND a.size <= b.remaining THEN b.files + 1 ELSE b.files END,
    CASE WHEN b.files >= {BUDGET.max_files} THEN 'file_limit_reached'
         WHEN a.size > b.remaining THEN 'byte_budget_reached' END
  FROM budget b JOIN accepted a ON a.repository_id = b.repository_id AND a.n = b.n + 1),
budgeted AS (SELECT repository_id, path, pos, reason AS skip_reason FROM budget WHERE n > 0)"""


def budgeted(spark, sf_dir):
    judged = filters.metadata_decision(manifest(spark, sf_dir), SIZE_LIMIT)
    return filters.apply_budgets(judged.where(F.col("skip_reason").isNull()).drop("skip_reason"), BUDGET)


@query("apply_budgets", with_ctes(*JUDGED, BUDGET_SQL, select="SELECT repository_id, path, skip_reason FROM budgeted"))
def apply_budgets(spark, sf_dir):
    return budgeted(spark, sf_dir).select("repository_id", "path", "skip_reason")


@query(
    "dedupe_by_blob",
    with_ctes(
        MANIFEST_SQL,
        select="""SELECT repository_id, sha, path, pos FROM manifest
                  QUALIFY row_number() OVER (PARTITION BY repository_id, sha ORDER BY pos DESC) = 1""",
    ),
)
def dedupe_by_blob(spark, sf_dir):
    return filters.dedupe_by_blob(manifest(spark, sf_dir)).select("repository_id", "sha", "path", "pos")


@query(
    "skip_report",
    with_ctes(
        *JUDGED, BUDGET_SQL,
        select="""SELECT repository_id, skip_reason, count(*) AS skipped,
                         sum(count(*)) OVER (PARTITION BY repository_id)::BIGINT AS total_skipped
                  FROM (SELECT repository_id, skip_reason FROM judged UNION ALL
                        SELECT repository_id, skip_reason FROM budgeted)
                  WHERE skip_reason IS NOT NULL GROUP BY repository_id, skip_reason""",
    ),
)
def skip_report(spark, sf_dir):
    judged = filters.metadata_decision(manifest(spark, sf_dir), SIZE_LIMIT).select("repository_id", "skip_reason")
    later = budgeted(spark, sf_dir).select("repository_id", "skip_reason")
    return filters.skip_report(judged.unionByName(later))


@query(
    "content_decision",
    """SELECT doc_id, CASE
         WHEN doc_id % 7 = 0 THEN CASE WHEN strlen(text) < 8000 THEN 'binary' END
         WHEN doc_id % 11 = 0 THEN 'decode_failed'
         WHEN doc_id % 13 = 0 THEN 'empty' END AS skip_reason FROM documents""",
)
def content_decision(spark, sf_dir):
    """Documents with a NUL appended, with an invalid byte pair, or blanked."""
    key, data = F.col("doc_id"), F.encode("text", "UTF-8")
    damaged = (
        F.when(key % 7 == 0, F.concat(data, F.lit(b"\x00")))
        .when(key % 11 == 0, F.concat(data, F.lit(b"\xc3\x28")))
        .when(key % 13 == 0, F.encode(F.rpad(F.lit(" \n"), 40, " "), "UTF-8"))
        .otherwise(data)
    )
    files = table(spark, sf_dir, "documents").select("doc_id", damaged.alias("content"))
    return filters.content_decision(files).select("doc_id", "skip_reason")


@query(
    "prepare_files",
    with_ctes(
        FILES_SQL,
        select="""SELECT path, size AS size_bytes, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count,
                         'text' AS language, 'text/plain' AS content_type, false AS is_parsed FROM files""",
    ),
)
def prepare_files(spark, sf_dir):
    return filters.prepare_files(document_files(spark, sf_dir)).select(
        "path", "size_bytes", "line_count", "language", "content_type", "is_parsed"
    )


PATH_FORMS = """path_forms AS (
  SELECT page_id, unnest([url, tail, '/' || tail, replace(tail, '/', chr(92)), tail || '/..', 'c:' || tail,
                          ' ' || tail || ' ']) AS path,
         unnest([1, 2, 3, 4, 5, 6, 7]) AS form
  FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS tail FROM pages))"""


@query(
    "valid_repository_path",
    with_ctes(
        PATH_FORMS,
        select="""SELECT page_id, form, length(trim(path)) BETWEEN 1 AND 1000 AND NOT contains(path, chr(92))
                    AND substr(trim(path), 2, 1) <> ':'
                    AND len(list_filter(string_split(trim(path), '/'), lambda s: s IN ('', '.', '..'))) = 0 AS allowed
                  FROM path_forms""",
    ),
)
def valid_repository_path(spark, sf_dir):
    tail = F.regexp_replace("url", "^[a-z]+://", "")
    forms = F.array(
        F.col("url"), tail, F.concat(F.lit("/"), tail), F.replace(tail, F.lit("/"), F.lit("\\")),
        F.concat(tail, F.lit("/..")), F.concat(F.lit("c:"), tail), F.concat(F.lit(" "), tail, F.lit(" ")),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("_n", "path"))
    return filters.valid_repository_path(rows).select("page_id", (F.col("_n") + 1).alias("form"), "allowed")


@query(
    "validate_queries",
    """SELECT doc_id, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(trim(text, ' ' || chr(10))) > 2000 THEN 'too_long'
                WHEN n_chars % 60 NOT BETWEEN 1 AND 50 THEN 'top_k_out_of_range' END AS rejected FROM documents""",
)
def validate_queries(spark, sf_dir):
    queries = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 60).alias("top_k"))
    return filters.validate_queries(queries).select("doc_id", "rejected")
