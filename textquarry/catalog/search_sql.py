"""DuckDB statements of semantic search, fusion and evidence, as CTE texts."""

from __future__ import annotations

from textquarry.catalog import lexical_sql
from textquarry.functions import vectors
from textquarry.settings import SEARCH

DIMENSIONS = 64
SCORE_DIGITS = 9


def slot(term: str) -> str:
    return f"('0x' || left(md5({term}), 8))::BIGINT % {DIMENSIONS}"


def sign(term: str) -> str:
    return f"CASE WHEN md5({term})[9] IN ('0','1','2','3','4','5','6','7') THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    expr = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        expr = f"({expr} * {x} + {c!r}::DOUBLE)"
    return expr


def normal_quantile(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    centre = f"(0.180625::DOUBLE - {q} * {q})"
    tail = f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6::DOUBLE)"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {polynomial(centre, vectors.CENTRE_NUM)} / {polynomial(centre, vectors.CENTRE_DEN)} "
        f"ELSE sign({q}) * {polynomial(tail, vectors.TAIL_NUM)} / {polynomial(tail, vectors.TAIL_DEN)} END"
    )


QUERY_SLOTS_SQL = f"""q_words AS (SELECT query_id, unnest(regexp_extract_all(text, {lexical_sql.WORDS})) AS word FROM queries),
q_terms AS (SELECT query_id, unnest({lexical_sql.terms_of('word')}) AS term FROM q_words),
q_slots AS (SELECT query_id, {slot('term')} AS slot, sum({sign('term')}) AS v FROM q_terms GROUP BY ALL),
q_norms AS (SELECT query_id, sqrt(sum(v * v)) AS size FROM q_slots GROUP BY query_id)"""

CHUNK_SLOTS_SQL = f"""c_slots AS (
  SELECT chunk_id, {slot('term')} AS slot, sum((tf_names + tf_body) * {sign('term')}) AS v FROM postings GROUP BY ALL),
c_norms AS (SELECT chunk_id, sqrt(sum(v * v)) AS size FROM c_slots GROUP BY chunk_id)"""

SEMANTIC_SQL = f"""{CHUNK_SLOTS_SQL},
{QUERY_SLOTS_SQL},
dots AS (
  SELECT q.query_id, c.chunk_id, sum(q.v * c.v) AS dot FROM q_slots q JOIN c_slots c USING (slot) GROUP BY ALL),
sims AS (
  SELECT q.query_id, c.chunk_id, round(coalesce(d.dot, 0) / (q.size * c.size), {SCORE_DIGITS}) AS score
  FROM q_norms q CROSS JOIN c_norms c LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = c.chunk_id
  WHERE q.size > 0 AND c.size > 0),
semantic AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS semantic_rank FROM sims
  QUALIFY semantic_rank <= {SEARCH.semantic_candidates})"""

POOL_SQL = """pool AS (
  SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.chunk_id, l.chunk_id) AS chunk_id,
         coalesce(s.score, x.score, 0) AS score, s.semantic_rank, coalesce(l.text_rank, 0) AS text_rank,
         coalesce(l.coverage, 0) AS coverage, coalesce(l.matched_terms, '') AS matched_terms
  FROM semantic s FULL JOIN covered l ON l.query_id = s.query_id AND l.chunk_id = s.chunk_id
  LEFT JOIN sims x ON x.query_id = l.query_id AND x.chunk_id = l.chunk_id)"""

SIGNALS_SQL = """detailed AS (
  SELECT p.*, c.repository_id, c.path, c.language, c.chunk_type, c.start_line, c.end_line, c.content,
         coalesce(i.identifiers, []) AS identifiers,
         NOT regexp_matches(c.content, '[\\p{L}\\p{N}]') AS low_value
  FROM pool p JOIN chunks c USING (chunk_id) LEFT JOIN identifiers i USING (query_id)),
signalled AS (
  SELECT *, CASE WHEN len(list_filter(identifiers, lambda t:
      (contains(trim(lower(t), '/'), '.') OR contains(trim(lower(t), '/'), '/')) AND
      (lower(path) = trim(lower(t), '/') OR ends_with(lower(path), '/' || trim(lower(t), '/'))
       OR string_split(lower(path), '/')[-1] = trim(lower(t), '/')))) > 0 THEN 'path' END AS named_as,
    len(list_filter(identifiers, lambda t: contains(lower(content), lower(t)))) > 0 AS mentioned
  FROM detailed),
exact AS (SELECT *, coalesce(named_as, CASE WHEN mentioned THEN 'identifier' END) AS exact_match FROM signalled)"""

EXCESS_SQL = f"""positioned AS (
  SELECT *, CASE WHEN semantic_rank IS NOT NULL AND NOT low_value THEN
      sum(CASE WHEN semantic_rank IS NOT NULL AND NOT low_value THEN 1 ELSE 0 END)
        OVER (PARTITION BY query_id ORDER BY semantic_rank NULLS LAST ROWS UNBOUNDED PRECEDING) END::BIGINT AS k FROM exact),
spread AS (
  SELECT query_id, count(k) AS n, avg(score) FILTER (WHERE k > 1) AS centre, stddev_pop(score) FILTER (WHERE k > 1) AS deviation,
         max(score) FILTER (WHERE k = 1) AS best FROM positioned GROUP BY query_id),
excess AS (
  SELECT p.*, p.k AS semantic_position,
    CASE WHEN p.k IS NOT NULL AND s.n >= {SEARCH.min_pool} AND s.deviation > 1e-12 THEN
      round((p.score - s.centre) / s.deviation - greatest({normal_quantile('((s.n - p.k + 0.625::DOUBLE) / (s.n + 0.25::DOUBLE))')}, 0), 6)
    END AS semantic_excess
  FROM positioned p JOIN spread s USING (query_id)),
separation AS (
  SELECT query_id, n AS pool_size, CASE WHEN n >= {SEARCH.min_pool} AND deviation > 1e-12 THEN round((best - centre) / deviation, 6) END
    AS semantic_separation FROM spread WHERE n > 0)"""


def position(column: str) -> str:
    counts = f"({column} IS NOT NULL AND NOT low_value)"
    place = (
        f"sum(CASE WHEN {counts} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY {column} NULLS LAST "
        "ROWS UNBOUNDED PRECEDING)"
    )
    return f"CASE WHEN {counts} THEN 1.0::DOUBLE / ({SEARCH.rrf_k} + {place}) ELSE 0 END"


FUSED_SQL = f"""lexically AS (
  SELECT *, CASE WHEN matched_terms <> '' THEN row_number() OVER (PARTITION BY query_id
    ORDER BY (matched_terms <> '') DESC, coverage DESC, text_rank DESC, chunk_id) END AS lexical_rank FROM excess),
ranked_lists AS (
  SELECT *,
    CASE WHEN named_as IS NOT NULL THEN row_number() OVER (PARTITION BY query_id
      ORDER BY CASE named_as WHEN 'symbol' THEN 0 WHEN 'path' THEN 1 ELSE 2 END,
               lexical_rank NULLS LAST, semantic_rank NULLS LAST, chunk_id) END AS named_rank,
    CASE WHEN mentioned THEN row_number() OVER (PARTITION BY query_id
      ORDER BY CASE WHEN mentioned THEN 0 ELSE 1 END, lexical_rank NULLS LAST, semantic_rank NULLS LAST, chunk_id) END AS mention_rank
  FROM lexically),
summed AS (
  SELECT *, round({position('semantic_rank')} + {position('lexical_rank')} + {position('named_rank')} + {position('mention_rank')}, 9) AS fused
  FROM ranked_lists),
fused_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, semantic_rank NULLS LAST, chunk_id) AS fused_rank FROM summed)"""

EXACT_KEEP_SQL = """one_copy AS (
  SELECT *, list_distinct(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS toks FROM fused_ranks
  QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(content, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) ORDER BY fused_rank) = 1)"""

NEAR_KEEP_SQL = f"""in_turn AS (
  SELECT query_id, chunk_id, fused_rank, toks, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS n FROM one_copy),
folded AS (
  SELECT query_id, 0::BIGINT AS n, ''::VARCHAR AS chunk_id, []::VARCHAR[][] AS kept, false AS stays FROM in_turn GROUP BY query_id
  UNION ALL
  SELECT query_id, n, chunk_id, CASE WHEN stays THEN list_append(kept, toks) ELSE kept END, stays FROM (
    SELECT i.query_id, i.n, i.chunk_id, i.toks, f.kept,
      NOT (len(i.toks) >= {SEARCH.near_min_tokens} AND len(list_filter(f.kept, lambda o: len(o) >= {SEARCH.near_min_tokens}
        AND CASE WHEN least(len(o), len(i.toks)) < {SEARCH.near_jaccard} * greatest(len(o), len(i.toks)) THEN false
            ELSE len(list_intersect(o, i.toks)) >= {SEARCH.near_jaccard} * (len(o) + len(i.toks) - len(list_intersect(o, i.toks))) END)) > 0) AS stays
    FROM folded f JOIN in_turn i ON i.query_id = f.query_id AND i.n = f.n + 1)),
survivors AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM folded WHERE n > 0 AND stays),
candidates AS (
  SELECT f.*, coalesce(s.rank, 0) AS rank, s.rank IS NOT NULL AS kept FROM fused_ranks f LEFT JOIN survivors s USING (query_id, chunk_id))"""

STRENGTH_SQL = f"""evidence AS (
  SELECT c.query_id,
    count(*) FILTER (WHERE kept AND NOT low_value) AS evidence_candidates,
    count(*) FILTER (WHERE kept AND NOT low_value AND exact_match IS NOT NULL) AS exact_matches,
    count(*) FILTER (WHERE kept AND NOT low_value AND coverage >= {SEARCH.strong_coverage}) AS strong_lexical,
    count(*) FILTER (WHERE kept AND NOT low_value AND matched_terms <> '') AS partial_lexical,
    count(*) FILTER (WHERE kept AND NOT low_value AND coverage >= {SEARCH.strong_coverage} AND semantic_position <= {SEARCH.agreement_depth}) AS corroborated,
    count(DISTINCT path) FILTER (WHERE kept AND NOT low_value AND (exact_match IS NOT NULL OR
      (coverage >= {SEARCH.strong_coverage} AND semantic_position <= {SEARCH.agreement_depth}))) AS agreeing_files,
    any_value(p.semantic_separation) AS semantic_separation,
    max(semantic_excess) FILTER (WHERE semantic_position = 1) AS best_excess
  FROM candidates c LEFT JOIN separation p USING (query_id) GROUP BY c.query_id),
strengths AS (
  SELECT *, CASE WHEN evidence_candidates = 0 THEN 'none'
    WHEN exact_matches > 0 OR corroborated > 0 OR coalesce(best_excess, -1e9) >= {SEARCH.useful_excess} THEN 'useful'
    WHEN strong_lexical > 0 OR coalesce(best_excess, -1e9) >= {SEARCH.weak_excess} THEN 'weak' ELSE 'none' END AS strength
  FROM evidence)"""
