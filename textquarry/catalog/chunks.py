"""Spans, symbols, gaps and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog.base import (
    CHUNKS_SQL,
    FILES_SQL,
    document_chunks,
    document_files,
    query,
    table,
    with_ctes,
)
from textquarry.functions import scan, text
from textquarry.operators import chunking, filters
from textquarry.settings import IndexLimits
from textquarry.sources import files as source_files

SPAN_LIMITS = IndexLimits(max_chunk_lines=6, max_chunk_chars=900)
SECTION, INNER_FROM, INNER_TO = 8, 2, 5


@query(
    "chunk_by_lines",
    with_ctes(
        FILES_SQL, CHUNKS_SQL,
        select="""SELECT chunk_id, repository_id, path, start_line, end_line, start_byte, end_byte,
                         md5(content) AS content_md5 FROM chunks""",
    ),
)
def chunk_by_lines(spark, sf_dir):
    return document_chunks(spark, sf_dir, one_corpus=False).select(
        "chunk_id", "repository_id", "path", "start_line", "end_line", "start_byte", "end_byte",
        F.md5("content").alias("content_md5"),
    )


def lined_files(spark, sf_dir):
    """Documents read as program text, so that comment markers and structure take part."""
    language = (
        F.when(F.col("path").startswith("en/"), "python")
        .when(F.col("path").startswith("fr/"), "javascript")
        .otherwise("text")
    )
    return document_files(spark, sf_dir).withColumn("language", language)


LINES_SQL = """doc_lines AS (
  SELECT repository_id, path, CASE WHEN path LIKE 'en/%' THEN 'python' WHEN path LIKE 'fr/%' THEN 'javascript' ELSE 'text' END AS language,
         unnest(string_split(content, chr(10))) AS line,
         unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_number FROM files),
kinds AS (
  SELECT *, CASE WHEN NOT regexp_matches(line, '[^ \\t]') THEN 'blank'
    WHEN language = 'python' AND ltrim(line) LIKE '#%' THEN 'comment'
    WHEN language = 'javascript' AND (ltrim(line) LIKE '//%' OR ltrim(line) LIKE '/*%' OR ltrim(line) LIKE '*/%' OR ltrim(line) LIKE '*%') THEN 'comment'
    WHEN NOT regexp_matches(line, '[\\p{L}\\p{N}]') THEN 'punctuation' ELSE 'code' END AS kind FROM doc_lines)"""


@query(
    "classify_lines",
    with_ctes(FILES_SQL, LINES_SQL, select="SELECT path, line_number, kind FROM kinds"),
)
def classify_lines(spark, sf_dir):
    return chunking.classify_lines(lined_files(spark, sf_dir)).select("path", "line_number", "kind")


@query(
    "is_trivia_only",
    with_ctes(FILES_SQL, LINES_SQL, select="SELECT path, count(*) FILTER (WHERE kind = 'code') = 0 AS trivia FROM kinds GROUP BY path"),
)
def is_trivia_only(spark, sf_dir):
    return lined_files(spark, sf_dir).select("path", text.is_trivia(F.col("content"), F.col("language")).alias("trivia"))


def document_spans(spark, sf_dir):
    """Two levels of spans from the documents: sections of eight lines and a part within each.

    Only full sections become spans, so the end of a document stays a top-level gap.
    """
    files = lined_files(spark, sf_dir)
    sizes = F.transform(text.split_lines_keep_ends(F.col("content")), lambda line: F.octet_length(line))
    offset = lambda n: F.aggregate(F.slice("sizes", F.lit(1), n), F.lit(0), lambda a, v: a + v)
    sections = files.select("repository_id", "path", sizes.alias("sizes")).select(
        "*",
        F.explode(
            F.when(
                F.size("sizes") >= SECTION, F.sequence(F.lit(0), F.floor(F.size("sizes") / SECTION).cast("int") - 1)
            )
        ).alias("s"),
    )
    first = F.col("s") * SECTION

    def span(start, end, kind, name, parent):
        return F.struct(
            offset(start).alias("start"), offset(end).alias("end"), F.lit(kind).alias("kind"),
            F.lit(kind).alias("node_type"), name.alias("name"), parent.alias("parent"),
        )

    outer = F.concat(F.lit("Section"), F.col("s").cast("string"))
    inner = F.concat(F.lit("part"), F.col("s").cast("string"))
    rows = sections.select(
        "repository_id", "path",
        F.inline(
            F.array(
                span(first, first + SECTION, "class", outer, F.lit(None).cast("string")),
                span(first + INNER_FROM, first + INNER_TO, "method", inner, outer),
            )
        ),
    )
    return chunking.collect_spans(files, rows)


SPANS_SQL = f"""lines0 AS (
  SELECT repository_id, path, unnest(string_split(content, chr(10))) AS body,
         unnest(range(0, len(string_split(content, chr(10))))) AS i,
         len(string_split(content, chr(10))) AS total FROM files),
lines1 AS (
  SELECT repository_id, path, i, CASE WHEN i < total - 1 THEN body || chr(10) ELSE body END AS line
  FROM lines0 WHERE NOT (i = total - 1 AND body = '')),
lines2 AS (
  SELECT *, strlen(line) AS bytes, i // {SECTION} AS s, i % {SECTION} AS r,
         count(*) OVER (PARTITION BY repository_id, path) AS n,
         coalesce(sum(strlen(line)) OVER (PARTITION BY repository_id, path ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0 FROM lines1),
sections AS (
  SELECT repository_id, path, s, min(at0) AS o_start, max(at0 + bytes) AS o_end, sum(length(line)) AS o_chars,
         string_agg(line, '' ORDER BY i) AS o_text,
         min(at0) FILTER (WHERE r BETWEEN {INNER_FROM} AND {INNER_TO - 1}) AS i_start,
         max(at0 + bytes) FILTER (WHERE r BETWEEN {INNER_FROM} AND {INNER_TO - 1}) AS i_end,
         string_agg(line, '' ORDER BY i) FILTER (WHERE r BETWEEN {INNER_FROM} AND {INNER_TO - 1}) AS i_text
  FROM lines2 WHERE s < n // {SECTION} GROUP BY ALL),
file_sizes AS (SELECT repository_id, path, strlen(content) AS size FROM files)"""


@query(
    "span_tree",
    with_ctes(
        FILES_SQL, SPANS_SQL,
        select="""SELECT path, 2 * s AS span_index, o_start AS start_byte, o_end AS end_byte, -1 AS parent_index, 0 AS depth FROM sections
                  UNION ALL SELECT path, 2 * s + 1, i_start, i_end, 2 * s, 1 FROM sections""",
    ),
)
def span_tree(spark, sf_dir):
    return chunking.span_tree(document_spans(spark, sf_dir)).select(
        "path", "span_index", "start_byte", "end_byte", F.coalesce("parent_index", F.lit(-1)).alias("parent_index"), "depth"
    )


@query(
    "emit_symbols",
    with_ctes(
        FILES_SQL, SPANS_SQL,
        select=f"""SELECT path, 'Section' || s AS symbol FROM sections
                   WHERE length(o_text) <= {SPAN_LIMITS.max_chunk_chars} AND regexp_matches(o_text, '[^ \\n]')
                   UNION ALL SELECT path, 'part' || s FROM sections
                   WHERE length(o_text) > {SPAN_LIMITS.max_chunk_chars} AND regexp_matches(i_text, '[^ \\n]')""",
    ),
)
def emit_symbols(spark, sf_dir):
    items = chunking.emit_symbols(document_spans(spark, sf_dir), SPAN_LIMITS)
    # A plain explode would compute the items once more, to leave out files without any.
    return items.select("path", F.explode_outer("_items.symbol").alias("symbol")).where("symbol IS NOT NULL").distinct()


@query(
    "gaps",
    with_ctes(
        FILES_SQL, SPANS_SQL,
        select=f"""SELECT path, o_start AS start_byte, i_start AS end_byte, 'block' AS chunk_type, 'Section' || s AS scope_symbol
                   FROM sections WHERE length(o_text) > {SPAN_LIMITS.max_chunk_chars} AND i_start > o_start
                   UNION ALL SELECT path, i_end, o_end, 'block', 'Section' || s
                   FROM sections WHERE length(o_text) > {SPAN_LIMITS.max_chunk_chars} AND o_end > i_end
                   UNION ALL SELECT path, coalesce(max(o_end), 0), size, 'module', ''
                   FROM file_sizes LEFT JOIN sections USING (repository_id, path) GROUP BY repository_id, path, size
                   HAVING size > coalesce(max(o_end), 0)""",
    ),
)
def gaps(spark, sf_dir):
    return chunking.gaps(document_spans(spark, sf_dir), SPAN_LIMITS).select(
        "path", "start_byte", "end_byte", "chunk_type", F.coalesce("scope_symbol", F.lit("")).alias("scope_symbol")
    )


@query("chunk_files")
def chunk_files(spark, sf_dir):
    return chunking.chunk_files(document_spans(spark, sf_dir), SPAN_LIMITS).select(
        "chunk_id", "path", "chunk_type", F.coalesce("symbol", F.lit("")).alias("symbol"),
        "start_line", "end_line", "start_byte", "end_byte", "part_index", "part_count",
    )


@query(
    "chunk_integrity",
    """SELECT source || '/' || lang || '/' || doc_id AS file, 0 AS overlaps, 0 AS wrong_content, 0 AS wrong_lines,
              0 AS uncovered FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{N}]')""",
)
def chunk_integrity(spark, sf_dir):
    """Structured chunks never overlap, match their ranges and leave nothing meaningful out."""
    files = document_spans(spark, sf_dir)
    report = chunking.chunk_integrity(chunking.chunk_files(files, SPAN_LIMITS), files)
    return report.select(
        F.concat_ws("/", "repository_id", F.regexp_replace("path", r"\.txt$", "")).alias("file"),
        "overlaps", "wrong_content", "wrong_lines", "uncovered",
    )


@query("attach_gap_trivia")
def attach_gap_trivia(spark, sf_dir):
    """Chunks whose range differs from the span they came from: trivia moved into them."""
    files = document_spans(spark, sf_dir)
    chunks = chunking.chunk_by_spans(files.where(F.size("spans") > 0), SPAN_LIMITS).where("symbol is not null")
    spans = files.select("repository_id", "path", F.inline("spans"))
    first = F.col("part_index") == 1
    return (
        chunks.where(first & F.col("chunk_type").isin("class", "method"))
        .join(spans.select("repository_id", "path", F.col("name").alias("symbol"), "start", "end"), ["repository_id", "path", "symbol"])
        .groupBy("path", "chunk_type")
        .agg(
            F.count("*").alias("symbols"),
            F.count_if(F.col("start_byte") < F.col("start")).alias("heading_attached"),
            F.count_if(F.col("end_byte") > F.col("end")).alias("tail_attached"),
        )
    )


@query("spans_by_pattern")
def spans_by_pattern(spark, sf_dir):
    """Declarations found in the scripts of the pages."""
    pages = source_files.pages_as_files(table(spark, sf_dir, "pages"))
    broken = F.regexp_replace(F.regexp_replace("content", ">", ">\n"), "[;]", ";\n")
    scripts = filters.detect_language(pages).withColumn("content", broken).withColumn("language", F.lit("javascript"))
    found = chunking.spans_by_pattern(scripts)
    return found.select("path", F.size("spans").alias("declarations"))


@query(
    "page_sections",
    """WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<p\\b[^>]*>.*?</p\\s*>') AS paragraphs,
    """
    + " + ".join(f"len(regexp_extract_all(html, '(?is)<h{n}\\\\b[^>]*>.*?</h{n}\\\\s*>'))".replace("\\\\", "\\") for n in range(1, 7))
    + """ AS headings,
    trim(regexp_replace(regexp_extract(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1), '<[^>]*>', '', 'g')) AS first_heading FROM pages)
SELECT 'pages/' || page_id || '.html' AS path, headings, len(paragraphs) AS paragraphs, md5(array_to_string(paragraphs, '')) AS paragraphs_md5, first_heading FROM found""",
)
def page_sections(spark, sf_dir):
    """Headings and paragraphs of all pages by the rules for HTML."""
    pages = source_files.pages_as_files(table(spark, sf_dir, "pages")).withColumn("language", F.lit("html"))
    found = chunking.spans_by_pattern(pages, {"html": scan.HTML})
    of = lambda node: F.filter("spans", lambda s: s["node_type"] == node)
    data = F.encode("content", "UTF-8")
    whole = F.array_join(F.transform(of("paragraph"), lambda s: F.decode(F.substring(data, s["start"] + 1, s["end"] - s["start"]), "UTF-8")), "")
    return found.select(
        "path", F.size(of("heading")).cast("bigint").alias("headings"), F.size(of("paragraph")).cast("bigint").alias("paragraphs"),
        F.md5(whole).alias("paragraphs_md5"), F.coalesce(F.get(of("heading"), 0)["name"], F.lit("")).alias("first_heading"),
    )
