"""DuckDB statements of tokenisation, postings, statistics and search, as CTE texts."""

from __future__ import annotations

from textquarry.functions import terms
from textquarry.operators.lexical import BODY_WEIGHT, NAME_WEIGHT, RANK_DIGITS

LEXICAL_LIMIT = 40


def parts_of(word: str) -> str:
    """Space-separated parts of an identifier; DuckDB has no look-around, so breaks are inserted."""
    expr = f"regexp_replace({word}, '[_$]+', ' ', 'g')"
    for pattern in (
        "([a-z0-9])([A-Z])",
        "([A-Z])([A-Z][a-z])",
        "([A-Za-z])([0-9])",
        "([0-9])([A-Za-z])",
    ):
        expr = f"regexp_replace({expr}, '{pattern}', '\\1 \\2', 'g')"
    return expr


def terms_of(word: str) -> str:
    whole = f"regexp_replace(lower({word}), '[^a-z0-9]', '', 'g')"
    parts = f"list_transform(string_split({parts_of(word)}, ' '), lambda p: lower(p))"
    return (
        f"list_concat(CASE WHEN {whole} <> '' THEN [{whole}] ELSE [] END, "
        f"list_filter({parts}, lambda p: length(p) >= {terms.MIN_PART_CHARS} AND p <> {whole}))"
    )


WORDS = "'[A-Za-z_$][A-Za-z0-9_$]*'"
STOP = "[" + ", ".join(f"'{w}'" for w in terms.STOP_WORDS) + "]"

# field words of each chunk -> terms, through the distinct words
POSTINGS_SQL = f"""chunk_words AS (
  SELECT repository_id, chunk_id, 1 AS is_name, unnest(regexp_extract_all(path, {WORDS})) AS word FROM chunks
  UNION ALL
  SELECT repository_id, chunk_id, 0, unnest(regexp_extract_all(content, {WORDS})) FROM chunks),
vocabulary AS (SELECT word, {terms_of('word')} AS word_terms FROM (SELECT DISTINCT word FROM chunk_words)),
chunk_term_rows AS (
  SELECT repository_id, chunk_id, is_name, unnest(word_terms) AS term FROM chunk_words JOIN vocabulary USING (word)),
chunk_lengths AS (SELECT chunk_id, count(*) AS chunk_terms FROM chunk_term_rows GROUP BY chunk_id),
postings AS (
  SELECT repository_id, term, chunk_id, sum(is_name)::BIGINT AS tf_names, sum(1 - is_name)::BIGINT AS tf_body,
         any_value(chunk_terms) AS chunk_terms
  FROM chunk_term_rows JOIN chunk_lengths USING (chunk_id) GROUP BY repository_id, term, chunk_id)"""

LOOKS_LIKE_CODE = (
    "(contains({t}, '_') OR contains({t}, '/') OR regexp_matches({t}, '[a-z][A-Z]') "
    "OR regexp_matches({t}, '[A-Za-z][.][A-Za-z]') "
    "OR (regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '[0-9]')))"
)

# queries(query_id, repository_id, text) must be defined
QUERY_TERMS_SQL = f"""raw_tokens AS (
  SELECT query_id, repository_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$./-]+')) AS raw,
         unnest(range(1, len(regexp_extract_all(text, '[A-Za-z0-9_$./-]+')) + 1)) AS i FROM queries),
tokens AS (
  SELECT query_id, repository_id, i, trim(raw, './-') AS token FROM raw_tokens WHERE trim(raw, './-') <> ''),
token_terms AS (
  SELECT query_id, repository_id, i, token, {LOOKS_LIKE_CODE.format(t='token')} AS code,
    CASE WHEN {LOOKS_LIKE_CODE.format(t='token')}
      THEN flatten(list_transform(regexp_extract_all(token, {WORDS}), lambda w: {terms_of('w')}))
      ELSE list_filter(string_split_regex(lower(token), '[^a-z0-9]+'), lambda w: w <> '') END AS ts
  FROM tokens),
spread_terms AS (
  SELECT query_id, repository_id, i, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS j FROM token_terms),
first_terms AS (
  SELECT query_id, repository_id, term, min(i * 100000 + j) AS seen FROM spread_terms
  WHERE NOT list_contains({STOP}, term) GROUP BY ALL),
query_terms AS (
  SELECT query_id, repository_id, row_number() OVER (PARTITION BY query_id ORDER BY seen) - 1 AS position, term
  FROM first_terms),
identifiers AS (
  SELECT query_id, list(token ORDER BY i) AS identifiers FROM (
    SELECT query_id, token, min(i) AS i FROM token_terms WHERE code GROUP BY query_id, token) GROUP BY query_id)"""

STATS_SQL = """totals AS (SELECT repository_id, count(*) AS total_chunks FROM chunks GROUP BY repository_id),
frequencies AS (SELECT repository_id, term, count(*) AS df FROM postings GROUP BY repository_id, term),
stats AS (
  SELECT a.repository_id, a.term, coalesce(t.total_chunks, 0) AS total_chunks, coalesce(f.df, 0) AS df,
         ln(1.0::DOUBLE + (greatest(coalesce(t.total_chunks, 0), 1) - coalesce(f.df, 0) + 0.5::DOUBLE)
            / (coalesce(f.df, 0) + 0.5::DOUBLE)) AS idf,
         coalesce(f.df, 0) * 2 <= greatest(coalesce(t.total_chunks, 0), 1) AS informative
  FROM (SELECT DISTINCT repository_id, term FROM query_terms) a
  LEFT JOIN totals t USING (repository_id) LEFT JOIN frequencies f USING (repository_id, term))"""

LEXICAL_SQL = f"""matches AS (
  SELECT q.query_id, p.chunk_id,
         round(sum({NAME_WEIGHT}::DOUBLE * tf_names + {BODY_WEIGHT}::DOUBLE * tf_body) / (1 + ln(max(chunk_terms))), {RANK_DIGITS}) AS text_rank,
         sum(s.idf) AS matched_idf, string_agg(q.term, ' ' ORDER BY q.position) AS matched_terms
  FROM query_terms q JOIN stats s ON s.repository_id = q.repository_id AND s.term = q.term AND s.df > 0 AND s.informative
  JOIN postings p ON p.repository_id = q.repository_id AND p.term = q.term GROUP BY q.query_id, p.chunk_id),
lexical_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, chunk_id) AS text_position FROM matches
  QUALIFY text_position <= {LEXICAL_LIMIT}),
weights AS (
  SELECT q.query_id, sum(s.idf) AS total_idf FROM query_terms q
  JOIN stats s ON s.repository_id = q.repository_id AND s.term = q.term AND s.informative GROUP BY q.query_id),
covered AS (
  SELECT h.query_id, h.chunk_id, h.text_rank, h.matched_terms, h.text_position,
         round(coalesce(h.matched_idf / nullif(w.total_idf, 0), 0), {RANK_DIGITS}) AS coverage
  FROM lexical_hits h LEFT JOIN weights w USING (query_id))"""
