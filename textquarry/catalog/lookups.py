"""Lookups, secrets, reads and evidence labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textquarry.catalog.base import (
    CHUNKS_SQL,
    CORPUS_FILES_SQL,
    FILES_SQL,
    MANIFEST_SQL,
    document_chunks,
    document_files,
    manifest,
    query,
    table,
    with_ctes,
)
from textquarry.catalog.files import LANGUAGE_SQL
from textquarry.functions import secrets
from textquarry.operators import filters, lookup, paging, secret_scan, symbol_index
from textquarry.operators.paging import Order
from textquarry.plans import index as plan
from textquarry.session import checkpoint_dir
from textquarry.sources import sinks

# Parts as symbols: the name joined like an identifier, the brand as its class.
SYMBOLS_SQL = """symbols AS (
  SELECT p_type AS repository_id, 'p/' || p_brand || '.py' AS path, p_partkey AS start_line,
         replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_size ELSE '' END AS symbol,
         replace(p_brand, '#', '') AS parent_symbol, p_partkey::VARCHAR AS chunk_id FROM part),
wanted AS (
  SELECT DISTINCT repository_id || ':' || word AS request_id, repository_id, lower(word) AS word FROM (
    SELECT p_type AS repository_id, unnest(list_concat(string_split(p_name, ' '), [p_brand[1:2] , upper(replace(p_name, ' ', '_'))])) AS word FROM part))"""


def symbols(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("repository_id"),
        F.concat(F.lit("p/"), "p_brand", F.lit(".py")).alias("path"),
        F.col("p_partkey").alias("start_line"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("_", name, F.col("p_size").cast("string"))).otherwise(name).alias("symbol"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("parent_symbol"),
        F.col("p_partkey").cast("string").alias("chunk_id"),
        F.col("p_name").alias("content"),
    )


@query(
    "find_symbol",
    with_ctes(
        SYMBOLS_SQL,
        select="""SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id
                    ORDER BY (lower(symbol) = word) DESC, length(symbol), path, start_line, chunk_id) AS match_rank
                  FROM wanted JOIN symbols USING (repository_id)
                  WHERE contains(lower(symbol), word) OR contains(lower(parent_symbol), word)
                  QUALIFY match_rank <= 5""",
    ),
)
def find_symbol(spark, sf_dir):
    """Every word of a part name, the start of a brand and whole names, within the part type."""
    words = F.concat(
        F.split("p_name", " "),
        F.array(F.substring("p_brand", 1, 2), F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))),
    )
    names = (
        table(spark, sf_dir, "part")
        .select(F.col("p_type").alias("repository_id"), F.explode(words).alias("name"))
        .distinct()
        .withColumn("request_id", F.concat_ws(":", "repository_id", "name"))
    )
    return lookup.find_symbol(names, symbols(spark, sf_dir)).select("request_id", "chunk_id", "match_rank")


@query(
    "find_symbol_stored",
    with_ctes(
        SYMBOLS_SQL,
        select="""SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id
                    ORDER BY (lower(symbol) = word) DESC, length(symbol), path, start_line, chunk_id) AS match_rank,
                    count(*) OVER (PARTITION BY request_id) AS matches
                  FROM wanted JOIN symbols USING (repository_id)
                  WHERE contains(lower(symbol), word) OR contains(lower(parent_symbol), word)
                  QUALIFY match_rank <= 5""",
    ),
)
def find_symbol_stored(spark, sf_dir):
    """The same names, looked up in a written dictionary under their rarest pieces."""
    words = F.concat(
        F.split("p_name", " "),
        F.array(F.substring("p_brand", 1, 2), F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("repository_id"), F.explode(words).alias("name")).distinct()
    names = parts.withColumn("request_id", F.concat_ws(":", "repository_id", "name"))
    path = f"{checkpoint_dir(spark)}/symbols-{uuid.uuid4().hex}"
    plan.write_symbols(path, "first", symbols(spark, sf_dir))
    index = symbol_index.SymbolIndex(*(sinks.read_table(spark, f"{path}/{name}").drop("run") for name in plan.SYMBOL_TABLES))
    return symbol_index.find_symbol(names, index, symbols(spark, sf_dir)).select("request_id", "chunk_id", "match_rank", "matches")


# Reads of every document: from a line depending on its id, some open-ended, some of missing files.
REQUESTS_SQL = """requests AS (
  SELECT doc_id AS request_id, source AS repository_id,
         CASE WHEN doc_id % 17 = 0 THEN 'missing/' || doc_id ELSE lang || '/' || doc_id || '.txt' END AS path,
         (doc_id % 9)::INT AS start_line, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 9 + doc_id % 13)::INT END AS end_line FROM documents),
held AS (
  SELECT repository_id, path, CASE WHEN content LIKE '%' || chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM files),
clamped AS (
  SELECT r.request_id, r.path, h.ls, len(ls) AS total, greatest(1, least(start_line, greatest(len(ls), 1))) AS s, end_line
  FROM requests r LEFT JOIN held h USING (repository_id, path)),
bounded AS (
  SELECT *, least(greatest(s, least(coalesce(end_line, total), total)), s + 9, total) AS e FROM clamped),
taken AS (
  SELECT request_id, s, total, unnest(ls[s:e]) AS line, unnest(range(s, e + 1)) AS n FROM bounded WHERE ls IS NOT NULL),
running AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY request_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS used FROM taken),
stops AS (SELECT request_id, min(n) AS stop FROM running WHERE used > 1500 AND n > s GROUP BY request_id),
shown AS (
  SELECT r.request_id, any_value(s) AS start_line, max(n) AS end_line, any_value(total) AS total_lines, md5(string_agg(line, chr(10) ORDER BY n)) AS content_md5
  FROM running r LEFT JOIN stops USING (request_id) WHERE stop IS NULL OR n < stop GROUP BY r.request_id)"""


def read_requests(spark, sf_dir):
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        key.alias("request_id"),
        F.col("source").alias("repository_id"),
        F.when(key % 17 == 0, F.concat(F.lit("missing/"), key.cast("string")))
        .otherwise(F.concat("lang", F.lit("/"), key.cast("string"), F.lit(".txt"))).alias("path"),
        (key % 9).cast("int").alias("start_line"),
        F.when(key % 4 != 0, key % 9 + key % 13).cast("int").alias("end_line"),
    )


@query(
    "read_ranges",
    with_ctes(
        FILES_SQL, REQUESTS_SQL,
        select="""SELECT r.request_id, coalesce(start_line, 0) AS start_line, coalesce(end_line, 0) AS end_line,
                         coalesce(total_lines, 0) AS total_lines, coalesce(end_line < total_lines, false) AS truncated,
                         coalesce(content_md5, '') AS content_md5, s.request_id IS NULL AS failed
                  FROM (SELECT request_id FROM requests) r LEFT JOIN shown s USING (request_id)""",
    ),
)
def read_ranges(spark, sf_dir):
    out = lookup.read_ranges(read_requests(spark, sf_dir), document_files(spark, sf_dir), max_lines=10, max_chars=1_500)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return out.select(
        "request_id", zero("start_line"), zero("end_line"), zero("total_lines"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
        F.coalesce(F.md5("content"), F.lit("")).alias("content_md5"), F.col("error").isNotNull().alias("failed"),
    )


# Customers read the parts of their line items: a span of lines per item.
SPANS_READ_SQL = """reads AS (
  SELECT o_custkey AS investigation_id, 'p' || (l_partkey % 5) AS path, (l_quantity * 3)::INT AS start_line,
         (l_quantity * 3 + l_linenumber)::INT AS end_line, l_orderkey * 100 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def spans_read(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    start = (F.col("l_quantity") * 3).cast("int")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("investigation_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("path"),
        start.alias("start_line"),
        (start + F.col("l_linenumber")).alias("end_line"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


@query(
    "unread_ranges",
    with_ctes(
        SPANS_READ_SQL,
        """merged AS (SELECT investigation_id, path, start_line, max(end_line) AS end_line FROM reads GROUP BY ALL),
cursors AS (
  SELECT *, coalesce(max(end_line) OVER (PARTITION BY investigation_id, path ORDER BY start_line
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS cur FROM merged)""",
        select="""SELECT investigation_id, path, cur AS unread_start, start_line - 1 AS unread_end FROM cursors WHERE start_line > cur
                  UNION ALL SELECT investigation_id, path, max(end_line) + 1, 200 FROM merged GROUP BY 1, 2 HAVING max(end_line) < 200""",
    ),
)
def unread_ranges(spark, sf_dir):
    reads = spans_read(spark, sf_dir)
    totals = reads.select("investigation_id", "path").distinct().withColumn("total_lines", F.lit(200))
    return lookup.unread_ranges(reads, totals)


@query(
    "register_evidence",
    with_ctes(
        SPANS_READ_SQL,
        select="""SELECT investigation_id, path, start_line, end_line, min(seq) AS first_seq,
                         'S' || row_number() OVER (PARTITION BY investigation_id ORDER BY min(seq), path, start_line, end_line) AS label
                  FROM reads GROUP BY investigation_id, path, start_line, end_line""",
    ),
)
def register_evidence(spark, sf_dir):
    spans = spans_read(spark, sf_dir).withColumn("symbol", F.lit(None).cast("string")).withColumn("origin", F.lit("read_file"))
    return lookup.register_evidence(spans).select("investigation_id", "path", "start_line", "end_line", "first_seq", "label")


@query(
    "excerpt",
    with_ctes(
        CORPUS_FILES_SQL, CHUNKS_SQL,
        select="""SELECT chunk_id, length(content) > 700 AS content_truncated,
                    length(CASE WHEN length(content) <= 700 THEN content
                      WHEN regexp_extract(left(content, 700), '(?s)^(.+)\\n', 1) <> '' THEN regexp_extract(left(content, 700), '(?s)^(.+)\\n', 1)
                      ELSE left(content, 700) END) AS chars FROM chunks""",
    ),
)
def excerpt(spark, sf_dir):
    out = lookup.excerpt(document_chunks(spark, sf_dir))
    return out.select("chunk_id", "content_truncated", F.length("excerpt").alias("chars"))


@query(
    "tool_activity_summary",
    """SELECT user_id AS investigation_id, event_type AS tool, count(*) AS calls,
              count(*) FILTER (WHERE (props->>'$.k')::INT >= 90) AS failures, sum((value * 100)::BIGINT)::BIGINT AS total_ms
       FROM events GROUP BY user_id, event_type""",
)
def tool_activity_summary(spark, sf_dir):
    """Events as tool calls; the number in their properties marks failures."""
    calls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("investigation_id"), F.col("event_type").alias("tool"),
        (F.get_json_object("props", "$.k").cast("int") < 90).alias("ok"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"),
    )
    return lookup.tool_activity_summary(calls)


@query(
    "language_breakdown",
    with_ctes(
        MANIFEST_SQL, LANGUAGE_SQL,
        select="""SELECT repository_id, language, count(*) AS files,
                         row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, language) AS position
                  FROM typed WHERE language IS NOT NULL GROUP BY repository_id, language""",
    ),
)
def language_breakdown(spark, sf_dir):
    return lookup.language_breakdown(filters.detect_language(manifest(spark, sf_dir)))


@query(
    "page",
    """SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total_rows FROM orders
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def page(spark, sf_dir):
    """Third page of fifty orders, newest first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lookup.page(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], limit=50, offset=100)


NEWEST = (Order("o_orderdate", descending=True), Order("o_orderkey"))


@query(
    "directory_page",
    """SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total_rows FROM orders
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET (SELECT count(*) // 2 FROM orders)""",
)
def directory_page(spark, sf_dir):
    """Fifty orders from the middle of all, found by the ranks of stored ranges."""
    path = f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    paging.write_directory(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), NEWEST, path)
    directory = paging.Directory(spark, path, NEWEST)
    return directory.page(50, directory.total() // 2)


@query(
    "directory_after",
    """SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey
       LIMIT 50 OFFSET (SELECT count(*) // 2 + 50 FROM orders)""",
)
def directory_after(spark, sf_dir):
    """The page behind that one, continued from its last row."""
    path = f"{checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}"
    paging.write_directory(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), NEWEST, path)
    directory = paging.Directory(spark, path, NEWEST)
    last = directory.page(50, directory.total() // 2).collect()[-1]
    return directory.after((last["o_orderdate"], last["o_orderkey"]), 50)


@query(
    "match_full_name",
    """SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) IN (SELECT lower(upper(replace(c_name, 'Customer', 'Supplier'))) FROM customer
         WHERE c_nationkey = s_nationkey)""",
)
def match_full_name(spark, sf_dir):
    """Suppliers that share nation and number with a customer, compared without case."""
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("owner"), F.col("s_name").alias("name")
    )
    wanted = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("owner"),
        F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name"),
    )
    return lookup.match_full_name(suppliers, wanted).select("s_suppkey", "s_name")


# ---- secrets -----------------------------------------------------------------

# Token shapes assembled from table values; the tables hold none in these formats.
PLANTED_SQL = """planted AS (
  SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'conf/.env' WHEN doc_id % 23 = 0 THEN 'conf/.env.example' ELSE 'src/a.py' END AS path,
    text || CASE doc_id % 8 WHEN 0 THEN ' ghp_' || repeat('a', 36) || ' ' WHEN 1 THEN ' AKIA' || repeat('B', 16) || ' '
      WHEN 2 THEN ' AIza' || repeat('c', 35) || ' ' WHEN 3 THEN ' xoxb-' || repeat('1', 12) || ' '
      WHEN 4 THEN chr(10) || '-----BEGIN RSA ' || 'PRIVATE KEY-----' || chr(10) ELSE '' END AS new_text FROM documents)"""


def planted(spark, sf_dir):
    key = F.col("doc_id")
    token = (
        F.when(key % 8 == 0, F.concat(F.lit(" ghp_"), F.repeat(F.lit("a"), F.lit(36)), F.lit(" ")))
        .when(key % 8 == 1, F.concat(F.lit(" AKIA"), F.repeat(F.lit("B"), F.lit(16)), F.lit(" ")))
        .when(key % 8 == 2, F.concat(F.lit(" AIza"), F.repeat(F.lit("c"), F.lit(35)), F.lit(" ")))
        .when(key % 8 == 3, F.concat(F.lit(" xoxb-"), F.repeat(F.lit("1"), F.lit(12)), F.lit(" ")))
        .when(key % 8 == 4, F.lit("\n-----BEGIN RSA " + "PRIVATE KEY-----\n"))
        .otherwise("")
    )
    path = F.when(key % 19 == 0, "conf/.env").when(key % 23 == 0, "conf/.env.example").otherwise("src/a.py")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.concat("text", token).alias("new_text"))


_KINDS_SQL = "[" + ", ".join(
    f"CASE WHEN regexp_matches(new_text, '{pattern}') THEN '{kind}' END" for kind, pattern in secrets.SECRET_PATTERNS.items()
) + f", CASE WHEN path LIKE '%/.env' THEN '{secrets.ENV_FILE}' END]"


@query(
    "scan_secrets",
    with_ctes(
        PLANTED_SQL,
        select=f"SELECT doc_id, path, kind FROM (SELECT doc_id, path, unnest({_KINDS_SQL}) AS kind FROM planted) WHERE kind IS NOT NULL",
    ),
)
def scan_secrets(spark, sf_dir):
    return secret_scan.scan_secrets(planted(spark, sf_dir))


@query(
    "redact_secrets",
    with_ctes(
        PLANTED_SQL,
        select=f"""SELECT doc_id, len(regexp_extract_all(new_text, '{secrets.ANY_SECRET}')) AS redactions,
                          md5(regexp_replace(new_text, '{secrets.ANY_SECRET}', '{secrets.REDACTED}', 'g')) AS text_md5 FROM planted""",
    ),
)
def redact_secrets(spark, sf_dir):
    out = secret_scan.redact_secrets(planted(spark, sf_dir), "new_text")
    return out.select("doc_id", "redactions", F.md5("new_text").alias("text_md5"))
