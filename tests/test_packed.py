"""Postings as one row per chunk: streamed, merged and searched without a row per term in a shuffle."""

import random

from pyspark.sql import functions as F

from textquarry.operators import lexical
from textquarry.plans import index as plan
from textquarry.settings import IndexLimits
from textquarry.sources import sinks
from textquarry.streaming import jobs

FILES = "repository_id string, path string, sha string, type string, size bigint, content string, pos bigint, version int"
CHUNKS = "repository_id string, path string, chunk_id string, parent_symbol string, symbol string, content string"


def test_a_streamed_index_stores_a_row_per_chunk_also_after_a_merge(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    for version in (1, 2):
        rows = [("r", f"f{i}.txt", f"{i}{version}", "blob", 30, f"alpha beta\nversion{version}\nline {i}\n", i, version) for i in range(9)]
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FILES).parquet(source)
        jobs.index_stream(stream, target, f"{target}-progress", IndexLimits(max_chunk_lines=2)).awaitTermination()
    stored = sinks.read_table(spark, f"{target}/postings")
    assert stored.count() == stored.select("chunk_id", "run").distinct().count() == 2 * 9 * 2
    term_rows = lambda: sorted(map(tuple, jobs.live_index(spark, target)["postings"].collect()))
    before = term_rows()
    assert len(before) > 18 and all(r[1] for r in before)
    merged = jobs.merge_runs(spark, target)
    assert term_rows() == before
    held = sinks.read_table(spark, f"{target}/postings").where(F.col("run") == merged)
    assert held.count() == 18 and held.where("terms IS NULL OR size(terms) = 0").isEmpty()


def searched_corpus(spark):
    rng = random.Random(3)
    words = [f"term{i}" for i in range(80)]
    rows = [
        ("r" if i % 4 else "s", f"f{i // 8}.txt", f"id{i:04d}", None, None, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(80)], k=rng.randint(1, 30))))
        for i in range(1500)
    ]
    rows += [("r", "same.txt", f"tie{i:03d}", None, None, "term50 term51") for i in range(700)] + [("r", "blank.txt", "blank", None, None, " 1 2 ")]
    rows += [("r", "twice.txt", "twice", None, None, text) for text in ("term70 term71", "term70 term72")]
    asked = [(q, "r" if q % 3 else "s", " ".join(rng.sample(words, 5))) for q in range(300)] + [(900, "r", "term50 term51"), (901, "r", "term70")]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, "query_id int, repository_id string, text string")


def plain_search(postings, searchable, limit):
    hits = postings.join(searchable, ["repository_id", "term"]).groupBy("query_id", "chunk_id").agg(
        lexical.text_rank().alias("text_rank"), F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t")
    )
    by_query = {}
    for r in hits.collect():
        by_query.setdefault(r.query_id, []).append((-r.text_rank, r.chunk_id, tuple(t.term for t in r.t)))
    return {q: sorted(rows)[:limit] for q, rows in by_query.items()}


def test_search_over_blocks_gives_all_best_hits(spark, monkeypatch):
    chunks, queries = searched_corpus(spark)
    postings, asked = lexical.build_postings(chunks), lexical.query_terms(queries)
    stats = lexical.term_statistics(postings, chunks, asked)
    expected = plain_search(postings, lexical.searchable_terms(stats, asked), 7)
    packed = lexical.packed_postings(chunks)
    for source, broadcast in ((packed, 50_000), (postings, 50_000), (packed, 0)):
        monkeypatch.setattr(lexical, "BROADCAST_TERMS", broadcast)
        found = {}
        search = lexical.lexical_search(source, stats, asked, 7)
        for r in search.collect():
            found.setdefault(r.query_id, []).append((r.text_position, -r.text_rank, r.chunk_id, tuple(r.matched_terms)))
        assert {q: [row[1:3] for row in sorted(rows)] for q, rows in found.items()} == {q: [row[:2] for row in rows] for q, rows in expected.items()}
        terms = {(q, r[2]): r[3] for q, rows in found.items() for r in rows}
        wanted = {(q, r[1]): r[2] for q, rows in expected.items() for r in rows if r[1] != "twice"}
        assert {k: terms[k] for k in wanted} == wanted
    once = packed.where("chunk_id <> 'twice'")
    plan_text = lexical.lexical_search(once, stats, asked, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline(terms" not in plan_text


def test_vectors_of_packed_postings_are_those_of_their_rows(spark):
    chunks, _ = searched_corpus(spark)
    made = lambda rows: sorted((r.chunk_id, r.embedding) for r in plan.chunk_vectors(rows).collect())
    packed = lexical.whole_chunks(lexical.packed_postings(chunks))
    assert made(packed) == made(lexical.build_postings(chunks))
    assert "Exchange" not in plan.chunk_vectors(lexical.packed_postings(chunks))._jdf.queryExecution().executedPlan().toString()


def test_diffs_are_rendered_some_files_at_a_time(spark):
    """All files of a batch were held as Python texts at once."""
    from textquarry.operators import diffs

    pairs = spark.range(150).selectExpr("id AS change_id", "concat('f', id) AS path", "'a\\nb' AS original", "concat('a\\nc', id) AS updated")
    made = diffs.unified_diff(pairs)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString() and diffs.ROWS_AT_ONCE < 150
    assert {r.path: r["diff"].split("\n")[-1] for r in made.collect()} == {f"f{i}": f"+c{i}" for i in range(150)}
