"""Context selection, rendering and citations for the searched questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog.base import CHUNKS_SQL, CORPUS_FILES_SQL, corpus_index, document_chunks, query, table, with_ctes
from textquarry.catalog.search import JUDGED, number, or_zero, searched
from textquarry.catalog.terms import benchmark_queries
from textquarry.functions import text
from textquarry.operators import citations, context
from textquarry.plans import search
from textquarry.session import cut_lineage
from textquarry.settings import ContextSettings

CONTEXT = ContextSettings(max_chars=6_000, max_sources=6)
CUT = CONTEXT.max_chars - CONTEXT.source_overhead

ELIGIBLE_SQL = """supported AS (
  SELECT *, (semantic_rank IS NULL AND lexical_rank IS NULL AND exact_match IS NULL) OR exact_match IS NOT NULL
      OR coverage >= 0.5 OR coalesce(semantic_excess >= 0.5, false) AS is_supported,
    bool_or(NOT low_value) OVER (PARTITION BY query_id) AS has_evidence
  FROM candidates WHERE rank > 0),
eligible AS (SELECT * FROM supported WHERE is_supported AND NOT (low_value AND has_evidence)),
nearest AS (
  SELECT c.* REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY semantic_rank NULLS LAST, rank) AS rank)
  FROM candidates c WHERE rank > 0 AND NOT low_value)"""


def diversified(source: str, name: str, where: str = "") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank) AS selection_order FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id, path ORDER BY rank) > {CONTEXT.per_file})::INT AS pass FROM {source} {where}))"""


ORDERED_SQL = (
    diversified("eligible", "ordered_supported", "JOIN (SELECT query_id, strength FROM strengths) USING (query_id) WHERE strength <> 'none'")
    + ",\n"
    + diversified("nearest", "ordered_nearest", "JOIN (SELECT query_id, strength FROM strengths) USING (query_id) WHERE strength = 'none'")
    + f""",
to_pack AS (
  SELECT *, {CONTEXT.max_sources} AS most FROM ordered_supported
  UNION ALL BY NAME SELECT *, {min(CONTEXT.max_sources, CONTEXT.no_evidence_sources)} AS most FROM ordered_nearest),
cut_short AS (
  SELECT *, CASE WHEN contains(left(content, {CUT}), chr(10))
      THEN regexp_extract(left(content, {CUT}), '(?s)^(.*)\\n', 1) ELSE left(content, {CUT}) END || '{context.TRUNCATED}' AS cut_content
  FROM to_pack),
packing AS (
  SELECT query_id, 0::BIGINT AS selection_order, ''::VARCHAR AS chunk_id, {CONTEXT.max_chars}::BIGINT AS remaining, 0 AS picked,
         NULL::INT AS label, false AS truncated FROM cut_short GROUP BY query_id
  UNION ALL
  SELECT query_id, selection_order, chunk_id,
    CASE WHEN whole THEN remaining - length(content) - {CONTEXT.source_overhead}
         WHEN short THEN remaining - length(cut_content) - {CONTEXT.source_overhead} ELSE remaining END,
    CASE WHEN whole OR short THEN picked + 1 ELSE picked END,
    CASE WHEN whole OR short THEN picked + 1 END, short FROM (
    SELECT *, NOT whole AND picked < most AND picked = 0 AS short FROM (
      SELECT c.query_id, c.selection_order, c.chunk_id, p.remaining, p.picked, c.content, c.cut_content, c.most,
             p.picked < c.most AND length(c.content) + {CONTEXT.source_overhead} <= p.remaining AS whole
      FROM packing p JOIN cut_short c ON c.query_id = p.query_id AND c.selection_order = p.selection_order + 1))),
selected AS (
  SELECT c.* EXCLUDE (content), CASE WHEN p.truncated THEN c.cut_content ELSE c.content END AS content, p.label, p.truncated
  FROM cut_short c JOIN packing p USING (query_id, selection_order))"""
)
SELECTED = (*JUDGED, ELIGIBLE_SQL, ORDERED_SQL)


def selection(spark, sf_dir):
    result = searched(spark, sf_dir)
    return result, context.select_context(result.sources(), result.strengths, CONTEXT)


@query("eligible", with_ctes(*JUDGED, ELIGIBLE_SQL, select="SELECT query_id, chunk_id, rank FROM eligible"))
def eligible(spark, sf_dir):
    return context.eligible(searched(spark, sf_dir).sources()).select(number("query_id"), "chunk_id", "rank")


@query(
    "diversify",
    with_ctes(*JUDGED, ELIGIBLE_SQL, diversified("eligible", "spread_out"), select="SELECT query_id, chunk_id, selection_order FROM spread_out"),
)
def diversify(spark, sf_dir):
    rows = context.diversify(context.eligible(searched(spark, sf_dir).sources()))
    return rows.select(number("query_id"), "chunk_id", "selection_order")


@query(
    "pack_budget",
    with_ctes(
        *SELECTED,
        select="SELECT query_id, chunk_id, selection_order, coalesce(label, 0) AS label, truncated, length(content) AS chars FROM selected",
    ),
)
def pack_budget(spark, sf_dir):
    return selection(spark, sf_dir)[1].select(
        number("query_id"), "chunk_id", "selection_order", or_zero("label"), "truncated", F.length("content").alias("chars")
    )


@query(
    "no_evidence_context",
    with_ctes(*JUDGED, ELIGIBLE_SQL, select="SELECT query_id, chunk_id, rank FROM nearest"),
)
def no_evidence_context(spark, sf_dir):
    return context.no_evidence_context(searched(spark, sf_dir).sources()).select(number("query_id"), "chunk_id", "rank")


RENDERED_SQL = f"""labelled AS (
  SELECT *, min(label) OVER (PARTITION BY query_id, path) AS file_order,
         row_number() OVER (PARTITION BY query_id, path ORDER BY start_line, label) = 1 AS opens FROM selected WHERE label IS NOT NULL),
blocks AS (
  SELECT query_id, repository_id, file_order, start_line, label, content,
    CASE WHEN opens THEN '--- ' || path || ' ---' || chr(10) ELSE '' END || '[S' || label || '] ' || path || ':' || start_line || '-' || end_line
      || '  (' || chunk_type || ', ' || language || ')' || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10) AS block
  FROM labelled),
rendered AS (
  SELECT query_id, count(*) AS sources, sum(length(content)) AS context_chars,
    'Repository: ' || any_value(repository_id) || chr(10) || chr(10) || '{context.INTRODUCTION}' || chr(10) || chr(10)
      || string_agg(block, chr(10) ORDER BY file_order, start_line, label) AS context FROM blocks GROUP BY query_id)"""


@query(
    "render_context",
    with_ctes(
        *SELECTED, RENDERED_SQL,
        select=f"""SELECT q.query_id, coalesce(sources, 0) AS sources, md5(coalesce(context, '{context.NOTHING_MATCHED}')) AS context_md5
                   FROM queries q LEFT JOIN rendered USING (query_id)""",
    ),
)
def render_context(spark, sf_dir):
    _, selected = selection(spark, sf_dir)
    asked = benchmark_queries(spark, sf_dir).withColumn("query_id", F.col("query_id").cast("string"))
    return context.render_all(asked, selected).select(
        number("query_id"), "sources", F.md5("context").alias("context_md5")
    )


@query(
    "search_summary",
    with_ctes(
        *SELECTED, RENDERED_SQL,
        select=f"""SELECT c.query_id, count(*) FILTER (WHERE kept) AS sources, count(semantic_rank) AS semantic_candidates,
                          count(lexical_rank) AS lexical_candidates, count(DISTINCT path) FILTER (WHERE kept) AS distinct_files,
                          any_value(strength) AS strength, (SELECT count(*) FROM chunks) AS searched_chunks,
                          coalesce(any_value(r.context_chars), 0)::BIGINT AS context_chars,
                          coalesce(any_value(r.sources), 0) AS selected_sources, {CONTEXT.max_chars} AS context_budget
                   FROM candidates c JOIN (SELECT query_id, strength FROM strengths) USING (query_id)
                   LEFT JOIN rendered r USING (query_id) GROUP BY c.query_id""",
    ),
)
def search_summary(spark, sf_dir):
    result, selected = selection(spark, sf_dir)
    out = search.search_summary(result, corpus_index(spark, sf_dir).chunks, selected, CONTEXT)
    return out.select(number("query_id"), *(c for c in out.columns if c not in ("query_id", "repository_id")))


@query(
    "seed_excerpts",
    with_ctes(
        *JUDGED,
        """top_five AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seed_rank,
    CASE WHEN length(content) <= 1200 THEN length(content)
         ELSE length(CASE WHEN regexp_extract(left(content, 1200), '(?s)^(.+)\\n', 1) <> ''
              THEN regexp_extract(left(content, 1200), '(?s)^(.+)\\n', 1) ELSE left(content, 1200) END) + """
        + str(len(context.ABBREVIATED))
        + """ END AS chars
  FROM candidates WHERE rank > 0 AND NOT low_value QUALIFY seed_rank <= 5),
used AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY seed_rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used_chars FROM top_five)""",
        select="SELECT query_id, chunk_id, seed_rank, used_chars FROM used WHERE seed_rank = 1 OR used_chars <= 4000",
    ),
)
def seed_excerpts(spark, sf_dir):
    seeds = context.seed_excerpts(searched(spark, sf_dir).sources(), budget=4_000)
    return seeds.select(number("query_id"), "chunk_id", "seed_rank", "used_chars")


@query(
    "location",
    with_ctes(CORPUS_FILES_SQL, CHUNKS_SQL, select="SELECT chunk_id, path || ':' || start_line || '-' || end_line AS location FROM chunks"),
)
def location(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir)
    return chunks.select("chunk_id", text.location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("location"))


@query(
    "qualified_symbol",
    """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand || '.' || p_name WHEN p_size % 3 = 1 THEN p_name
                         WHEN p_size % 2 = 0 THEN p_brand END, '') AS qualified FROM part""",
)
def qualified_symbol(spark, sf_dir):
    size = F.col("p_size")
    symbol = F.when(size % 3 != 2, F.col("p_name")).otherwise("")
    parent = F.when((size % 3 == 0) | ((size % 3 == 2) & (size % 2 == 0)), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(text.qualified_symbol(parent, symbol), F.lit("")).alias("qualified")
    )


# ---- citations ---------------------------------------------------------------


def question_answers(spark, sf_dir):
    return benchmark_queries(spark, sf_dir).select(
        F.concat(F.lit("m"), F.col("query_id").cast("string")).alias("message_id"),
        F.col("query_id").cast("string").alias("query_id"),
    )


@query(
    "persist_citations",
    with_ctes(
        *SELECTED,
        select="""SELECT 'm' || query_id AS message_id, chunk_id, label AS rank, 'S' || label AS label, path, start_line, end_line,
                         language, score FROM selected WHERE label IS NOT NULL""",
    ),
)
def persist_citations(spark, sf_dir):
    _, selected = selection(spark, sf_dir)
    rows = citations.persist_citations(question_answers(spark, sf_dir), selected)
    return rows.drop("symbol")


@query(
    "turn_metadata",
    with_ctes(
        *SELECTED,
        select=f"""SELECT 'm' || q.query_id AS message_id, count(label) AS sources, count(DISTINCT path) FILTER (WHERE label IS NOT NULL) AS distinct_files,
                          CASE WHEN count(label) = 0 THEN 'none' ELSE any_value(g.strength) END AS strength,
                          coalesce(sum(length(content)) FILTER (WHERE label IS NOT NULL), 0)::BIGINT AS context_chars,
                          count(*) FILTER (WHERE truncated) AS truncated_sources
                   FROM queries q JOIN (SELECT query_id, strength FROM strengths) g USING (query_id) LEFT JOIN selected s USING (query_id) GROUP BY q.query_id""",
    ),
)
def turn_metadata(spark, sf_dir):
    result, selected = selection(spark, sf_dir)
    selected = cut_lineage(selected)
    summary = search.search_summary(result, corpus_index(spark, sf_dir).chunks, selected, CONTEXT).select(
        "query_id", "strength", "searched_chunks", "semantic_candidates", "lexical_candidates", "context_budget"
    )
    rows = citations.turn_metadata(question_answers(spark, sf_dir), selected, summary)
    fields = ("sources", "distinct_files", "strength", "context_chars", "truncated_sources")
    return rows.select("message_id", *(F.col(f"retrieval_metadata.{name}").alias(name) for name in fields))


@query(
    "conversation_titles",
    """SELECT conv_id AS conversation_id, left(arg_min(text, turn), 120) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id""",
)
def conversation_titles(spark, sf_dir):
    from textquarry.sources.files import conversations_as_messages

    return citations.conversation_titles(conversations_as_messages(table(spark, sf_dir, "conversations")))


# Assistant turns that cite: labels depend on turn and length, each turn has turn + 1 sources.
ANSWERS_SQL = """answers AS (
  SELECT conv_id || '-' || turn AS message_id, turn + 1 AS known,
         'First [S' || (length(text) % 5 + 1) || ', S' || (turn + 1) || ']. ' || text || ' [S' || (length(text) % 7 + 1) || '].' AS content,
         ['S' || (length(text) % 5 + 1), 'S' || (turn + 1), 'S' || (length(text) % 7 + 1)] AS labels,
         'First' || CASE WHEN length(text) % 5 < turn + 1 THEN ' [S' || (length(text) % 5 + 1) || ', S' || (turn + 1) || ']'
                    ELSE ' [S' || (turn + 1) || ']' END || '. ' || text
           || CASE WHEN length(text) % 7 < turn + 1 THEN ' [S' || (length(text) % 7 + 1) || ']' ELSE '' END || '.' AS cleaned
  FROM conversations WHERE role = 'assistant')"""


def cited_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    label = lambda value: F.concat(F.lit("S"), value.cast("string"))
    chars, turn = F.length("text"), F.col("turn")
    answers = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("message_id"),
        F.concat(
            F.lit("First ["), label(chars % 5 + 1), F.lit(", "), label(turn + 1), F.lit("]. "), F.col("text"),
            F.lit(" ["), label(chars % 7 + 1), F.lit("]."),
        ).alias("content"),
        "turn",
    )
    sources = answers.select(
        "message_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("turn") + 1)).alias("rank")
    ).withColumn("label", label(F.col("rank")))
    return answers.drop("turn"), sources


@query(
    "resolve_citations",
    with_ctes(
        ANSWERS_SQL,
        select="""SELECT message_id, len(list_distinct(labels)) AS cited,
                         len(list_filter(list_distinct(labels), lambda l: l[2:]::INT <= known)) AS resolved,
                         len(list_filter(list_distinct(labels), lambda l: l[2:]::INT > known)) AS unresolved, md5(cleaned) AS text_md5
                  FROM answers""",
    ),
)
def resolve_citations(spark, sf_dir):
    out = citations.resolve_citations(*cited_answers(spark, sf_dir))
    return out.select("message_id", F.size("cited").alias("cited"), "resolved", "unresolved", F.md5("content").alias("text_md5"))


@query(
    "order_evidence",
    with_ctes(
        ANSWERS_SQL,
        """shown AS (
  SELECT message_id, unnest(range(1, known + 1)) AS rank, labels FROM answers)""",
        select="""SELECT message_id, rank, list_contains(labels, 'S' || rank) AS cited,
                         row_number() OVER (PARTITION BY message_id ORDER BY list_contains(labels, 'S' || rank) DESC, rank) AS display_order,
                         least(3, count(*) OVER (PARTITION BY message_id)) AS distinct_files
                  FROM shown""",
    ),
)
def order_evidence(spark, sf_dir):
    answers, sources = cited_answers(spark, sf_dir)
    placed = sources.withColumn("path", F.concat(F.lit("f"), (F.col("rank") % 3).cast("string")))
    return citations.order_evidence(placed, answers).select("message_id", "rank", "cited", "display_order", "distinct_files")


@query(
    "preview_line",
    with_ctes(
        CORPUS_FILES_SQL, CHUNKS_SQL,
        select="""SELECT chunk_id, coalesce(CASE WHEN length(l) > 96 THEN left(l, 95) || '…' ELSE l END, '') AS preview FROM (
                    SELECT chunk_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)),
                      lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|/[*]|[*]|@|[{]/[*])'))[1] AS l FROM chunks)""",
    ),
)
def preview_line(spark, sf_dir):
    chunks = document_chunks(spark, sf_dir)
    return chunks.select("chunk_id", F.coalesce(text.preview_line(F.col("content")), F.lit("")).alias("preview"))
