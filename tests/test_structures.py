"""Stored structures, sources and streams: directories, quantiles, symbols, files, answers and runs."""

import os
import random
import statistics
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textquarry.operators import fusion, lookup, paging, quantiles, results, symbol_index
from textquarry.operators.paging import Order
from textquarry.plans import search
from textquarry.settings import IndexLimits
from textquarry.sources import corpus_source
from textquarry.streaming import jobs

# ---- rank directory ----------------------------------------------------------

NEWEST = (Order("at", descending=True), Order("key"))


def paged(spark, tmp_path, n=500):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(40)]), f"p{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "key bigint, at bigint, payload string").repartition(3)
    paging.write_directory(frame, NEWEST, str(tmp_path / "d"), least_ranges=16)
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return paging.Directory(spark, str(tmp_path / "d"), NEWEST), ordered


def test_a_page_reads_only_its_ranges(spark, tmp_path):
    directory, ordered = paged(spark, tmp_path)
    for offset in (0, 7, 130, 470, 499, 500, 10_000):
        page = directory.page(30, offset)
        assert [(r.key, r["at"], r.payload, r.total_rows) for r in page.collect()] == [(*r, 500) for r in ordered[offset : offset + 30]]
    page = directory.page(10, 250)
    page.collect()
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1][:60]
    assert directory.ranges.where("first_rank < 260 AND first_rank + rows > 250").count() <= 2 < directory.ranges.count()


def test_a_key_continues_behind_a_page(spark, tmp_path):
    directory, ordered = paged(spark, tmp_path)
    for at in (0, 100, 260, 498, 499):
        key = (ordered[at][1], ordered[at][0])
        assert [r.key for r in directory.after(key, 25).collect()] == [r[0] for r in ordered[at + 1 : at + 26]]


def test_a_directory_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "key bigint, at bigint")
    paging.write_directory(frame, NEWEST, str(tmp_path / "d"))
    assert paging.Directory(spark, str(tmp_path / "d"), NEWEST).page(5).collect() == []


# ---- quantiles ---------------------------------------------------------------


def measured(spark, n=4000):
    rng = random.Random(2)
    rows = []
    for _ in range(n):
        group = rng.choice(["hot", "hot", "hot", "b", None])
        value = rng.choice([None, rng.randrange(-(10**12), 10**12), rng.randrange(5), 7])
        rows.append((group, rng.randrange(6), value))
    return rows + [("one", 0, 5), ("none", 0, None), ("even", 0, 1), ("even", 0, 4)]


@pytest.mark.parametrize("buckets", [2, 256])
def test_medians_are_exact(spark, buckets):
    rows = measured(spark, 600 if buckets == 2 else 4000)
    frame = spark.createDataFrame(rows, "g string, day int, v bigint").withColumn("rank", F.lit("clash")).withColumn("low", F.lit("clash"))
    got = {r["g"]: (r["n"], r["median"]) for r in quantiles.exact_median(frame, ["g"], "v", buckets).collect()}
    held = defaultdict(list)
    for g, _, v in rows:
        held[g] += [] if v is None else [v]
    assert got == {g: (len(v), float(statistics.median(v)) if v else None) for g, v in held.items()}


def test_daily_sketches_merge_to_the_whole(spark):
    rows = [r for r in measured(spark, 20_000) if r[0] == "hot" and r[2] is not None]
    days = quantiles.daily_sketches(spark.createDataFrame(rows, "g string, day int, v bigint"), ["g"], "day", "v")
    assert days.count() == 6
    values = sorted(v for *_, v in rows)
    for rank in (0.1, 0.5, 0.9):
        (r,) = quantiles.merged_quantile(days, ["g"], rank).collect()
        below, upto = sum(v < r["quantile"] for v in values), sum(v <= r["quantile"] for v in values)
        assert r["n"] == len(values) and below / len(values) - 0.02 <= rank <= upto / len(values) + 0.02


# ---- symbols -----------------------------------------------------------------


@pytest.mark.parametrize("part_rows", [50_000, 3])
def test_stored_symbols_are_found_like_scanned_ones(spark, part_rows):
    rng = random.Random(4)
    parts = ["get", "set", "user", "name", "id", "a", "xy", "Ünï"]
    rows = [
        (rng.choice(["r", "s"]), f"f{i % 7}.py", i, rng.choice([None, "_".join(rng.sample(parts, rng.randint(1, 3)))]), rng.choice([None, "Box", "userBox"]), f"c{i}", "x = 1")
        for i in range(200)
    ]
    chunks = spark.createDataFrame(rows, "repository_id string, path string, start_line int, symbol string, parent_symbol string, chunk_id string, content string")
    asked = ["get", "USER", "a", "xy", "get_user", "box", "no such", "", "  id ", "ünï", "e"]
    names = spark.createDataFrame([(f"{r}:{n}", r, n) for r in "rst" for n in asked], "request_id string, repository_id string, name string")
    index = symbol_index.build_symbols(chunks, part_rows)
    plain = lookup.find_symbol(names, chunks, 4).select("request_id", "chunk_id", "match_rank").collect()
    stored = symbol_index.find_symbol(names, index, chunks, 4)
    assert sorted(map(tuple, stored.select("request_id", "chunk_id", "match_rank").collect())) == sorted(map(tuple, plain))
    every = Counter(r.request_id for r in lookup.find_symbol(names, chunks, 10_000).collect())
    assert {(r.request_id, r.matches) for r in stored.collect()} == set(every.items())
    if part_rows == 3:
        assert index.counts.agg(F.max("parts")).first()[0] > 5


# ---- files -------------------------------------------------------------------


def tree(tmp_path):
    root = tmp_path / "a b"
    held = {"x.txt": b"one", "d/y.txt": b"", "d/e/z.bin": bytes(range(256)) * 40, "d/e/f/w.txt": "ü".encode(), ".hidden": b"h", "q/r.txt": b"last"}
    for name, data in held.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root, held


def test_files_come_whole_or_in_parts(spark, tmp_path):
    root, held = tree(tmp_path)
    found = corpus_source.read_corpus(spark, str(root), part_bytes=1000, tasks=3).collect()
    whole = defaultdict(dict)
    for r in found:
        assert r.size == len(held[r.path]) and r.skip_reason is None and r["offset"] == r.part * 1000
        whole[r.path][r.part] = bytes(r.content)
        assert r.parts == max(1, -(-r.size // 1000))
    assert {p: b"".join(parts[i] for i in range(len(parts))) for p, parts in whole.items()} == held
    manifest = {r.path: (r.content and bytes(r.content), r.skip_reason) for r in corpus_source.corpus_manifest(spark, str(root), "r", 1000).collect()}
    assert manifest["d/e/z.bin"] == (None, "in_parts") and manifest["x.txt"] == (b"one", None) and len(manifest) == 6


def test_listing_is_split_and_filters_are_pushed(spark, tmp_path):
    root, held = tree(tmp_path)
    frame = corpus_source.read_corpus(spark, str(root), tasks=2, contents="false")
    assert frame.rdd.getNumPartitions() > 1
    assert {r.path for r in frame.collect()} == set(held) and all(r.content is None for r in frame.collect())
    small = corpus_source.read_corpus(spark, str(root)).where("size < 4 AND size > 0 AND path LIKE 'd/%'")
    assert [r.path for r in small.collect()] == ["d/e/f/w.txt"]
    assert {r.path for r in corpus_source.read_corpus(spark, str(root), glob="*.txt").collect()} == {p for p in held if p.endswith(".txt")}
    assert corpus_source.read_corpus(spark, str(tmp_path / "nothing")).collect() == []


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads everything")
def test_a_file_without_permission_keeps_its_row(spark, tmp_path):
    root, _ = tree(tmp_path)
    (root / "x.txt").chmod(0)
    (row,) = corpus_source.read_corpus(spark, str(root)).where("path = 'x.txt'").collect()
    assert row.skip_reason == "unreadable" and row.content is None


def test_a_file_that_shrinks_while_it_is_read_keeps_its_row(tmp_path):
    reader = corpus_source._Reader(str(tmp_path), None, 4, 1, True)
    (tmp_path / "f").write_bytes(b"abcdef")
    store, _ = corpus_source._open(str(tmp_path))
    rows = list(reader._parts(store, str(tmp_path / "f"), "f", 10))
    assert [(r[1], r[5], r[6]) for r in rows] == [(0, b"abcd", None), (1, None, "unreadable")]
    assert next(reader._parts(store, str(tmp_path / "gone"), "gone", 3))[6] == "unreadable"


# ---- streams -----------------------------------------------------------------

DELTAS = "message_id string, seq int, kind string, text string, ts timestamp"


def plain_answers(rows):
    out = {}
    for message in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == message]
        ends = [r[1] for r in own if r[2] == "done" and r[1] is not None]
        texts = defaultdict(list)
        for _, seq, kind, said, _ in own:
            if kind == "text" and seq is not None and said is not None:
                texts[seq].append(said)
        if ends and not any(r[2] == "error" for r in own) and all(i in texts for i in range(max(ends))):
            out[message] = ("".join(min(texts[i]) for i in range(max(ends))), max(ends))
    return out


def delta_rows(seed=6):
    rng = random.Random(seed)
    rows = []
    for m in range(40):
        n, ts = rng.choice([0, 1, 3, 200]), 1_704_067_200 + rng.randrange(300)
        own = [(f"m{m}", i, "text", f"t{i} ", ts) for i in range(n)]
        fate = m % 5
        own += [] if fate == 0 else [(f"m{m}", n, "done", None, ts)]
        own += [(f"m{m}", None, "error", None, ts + 1)] if fate == 1 else []
        if fate == 2 and n:
            own.pop(0)
        own += rng.sample(own, min(3, len(own)))
        own += [(f"m{m}", 0, "text", "other", ts)] if fate == 3 and n else []
        rows += own
    rows += [(None, 0, "text", "x", 1_704_067_200), ("m2", 5000, "text", "beyond", 1_704_067_200)]
    rng.shuffle(rows)
    return rows


def test_answers_do_not_depend_on_order_batches_or_repeats(spark, tmp_path):
    rows = delta_rows()
    expected = plain_answers(rows)
    kinds = DELTAS.replace("timestamp", "bigint")
    frame = lambda some: spark.createDataFrame(some, kinds).withColumn("ts", F.timestamp_seconds("ts"))
    got = {r.message_id: (r.answer, r.deltas) for r in jobs.assemble_answers_batch(frame(rows)).collect()}
    assert got == expected and len(got) > 10
    jobs.use_rocksdb(spark)
    tick = [("tick", None, "tick", None, 1_704_067_200 + 100_000)]
    for i, some in enumerate((rows[::3], rows[1::3], rows[2::3], tick)):
        frame(some).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.assemble_answers(spark.readStream.schema(frame(rows).schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "progress")
        ).trigger(availableNow=True).start().awaitTermination()
    out = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {m: (a, n) for m, a, n in out} == expected and len(out) == len(expected)


FILES = "repository_id string, path string, sha string, type string, size bigint, content string, pos bigint, version int"


def delivery(spark, texts, version):
    rows = [("r", path, f"{path}{version}", "blob", len(text.encode()), text, i, version) for i, (path, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, FILES).withColumn("sha", F.sha2("content", 256))


def counted(live):
    sums = live["term_counts"].groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()
    totals = live["repository_counts"].agg(F.sum("chunks"), F.sum("lexical_chunks")).first()
    return {r.term: r.df for r in sums}, tuple(totals)


def scanned(live):
    terms = {r.term: r["count"] for r in live["postings"].groupBy("term").count().collect()}
    named = live["postings"].where("tf_body > 0").select("chunk_id").distinct().count()
    return terms, (live["chunks"].count(), named)


def rows_of(live):
    return sorted((r.path, r.chunk_id, r.content) for r in live["chunks"].collect()), sorted(
        (r.chunk_id, r.content_hash, r.embedding) for r in live["embeddings"].collect()
    )


def test_counts_vectors_and_merging_of_a_streamed_index(spark, tmp_path):
    source, target, limits = str(tmp_path / "in"), str(tmp_path / "index"), IndexLimits(max_chunk_lines=2)
    first = {f"f{i}.txt": f"alpha beta\nline{i}\ngamma {i % 3}\n" for i in range(12)}
    steps = [
        (first, 1),
        ({"f1.txt": "alpha changed\n", "f2.txt": "", "new.txt": first["f3.txt"]}, 2),
        ({"f1.txt": "late and outdated\n", "f5.txt": "delta\nalpha beta\n"}, 1),  # f1 comes late, f5 not newer by name alone
        ({"f1.txt": first["f1.txt"]}, 3),
    ]
    for i, (texts, version) in enumerate(steps):
        rows = delivery(spark, texts, version)
        rows.write.mode("append").parquet(source)
        jobs.index_stream(spark.readStream.schema(rows.schema).parquet(source), target, str(tmp_path / "progress"), limits).awaitTermination()
        live = jobs.live_index(spark, target)
        assert counted(live) == scanned(live), i
        if i == 1:
            before = rows_of(live)
            assert jobs.merge_runs(spark, target) == "merged-000000000000"
            assert rows_of(jobs.live_index(spark, target)) == before
    live = jobs.live_index(spark, target)
    reused = {r.path: r.reused for r in live["embeddings"].select("path", "reused").collect()}
    assert reused["f1.txt"]  # its text was embedded two versions ago
    before = rows_of(live)
    # An interrupted merge has written rows of an unpublished run: nothing changes.
    spark.read.parquet(f"{target}/chunks").where("path = 'f3.txt'").withColumn("run", F.lit("merged-000000000009")).write.partitionBy("run").mode("append").parquet(
        f"{target}/chunks"
    )
    assert rows_of(jobs.live_index(spark, target)) == before
    jobs.merge_runs(spark, target)
    assert rows_of(jobs.live_index(spark, target)) == before
    gone = jobs.drop_covered(spark, target)
    assert len(gone) >= 4
    live = jobs.live_index(spark, target)
    assert rows_of(live) == before and counted(live) == scanned(live)
    assert len({r.run for r in spark.read.parquet(f"{target}/embeddings").select("run").distinct().collect()}) == 1
    rows = delivery(spark, {"f1.txt": "after merging\n"}, 4)
    rows.write.mode("append").parquet(source)
    jobs.index_stream(spark.readStream.schema(rows.schema).parquet(source), target, str(tmp_path / "progress"), limits).awaitTermination()
    live = jobs.live_index(spark, target)
    assert counted(live) == scanned(live) and "merging" in counted(live)[0]


# ---- replies, blanks, models -------------------------------------------------

REPLIES = [
    ('before {"summary": "a"} after', '{"summary": "a"}'),
    ('{"summary": {"outcome": "inner"}} {"x": 1}', '{"summary": {"outcome": "inner"}}'),
    ('```json\n{"outcome": "f", "code": "```"}\n```\n{"summary": "bare"}', '{"outcome": "f", "code": "```"}'),
    ('```\n{"x": 1}\n``` {"summary": "bare"}', None),
    ('{"a": { "b"  {"outcome": "x"}', '{"outcome": "x"}'),
    ('{"outcome": NaN} {"summary": 1', None),
    ("no braces", None), ("", None), (None, None),
]


def test_results_are_read_from_replies(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, text string")
    got = {r.i: r.payload for r in results.extract_json(frame).collect()}
    assert got == {i: p for i, (_, p) in enumerate(REPLIES)}


def test_a_reply_of_many_braces_is_read_once(spark):
    def seconds(n):
        reply = "{ " * n + '{"summary": "s"}' + "{} " * n
        began = time.process_time()
        assert results._payload(reply) == '{"summary": "s"}'
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * seconds(4_000) + 1


def test_blanks_outside_ascii_make_no_other_fingerprint(spark):
    texts = ["a b\nc", "a\xa0b  c ", " a b c", "a\x1cb c", "a bc"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(fusion.fingerprint(F.col("t")).alias("f"))
    assert [r.f for r in frame.collect()] == ["a b c"] * 4 + ["a bc"]


def test_only_vectors_of_the_asked_model_are_ranked(spark):
    rows = [("r1", "c1", "p", "m", 2, [1.0, 0.0]), ("r1", "c2", "p", "old", 2, [1.0, 0.0]), ("r2", "c3", "p", "old", 2, [1.0, 0.0]), ("r3", "c4", "p", "m", 3, [1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "repository_id string, chunk_id string, provider string, model string, dimensions int, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", f"r{i}") for i in range(1, 5)], "query_id string, repository_id string")
    refused = {r.query_id: r.reason for r in search.refused_queries(queries, vectors, "p", "m", 2).collect()}
    assert refused == {"q2": "other_model", "q3": "other_model", "q4": "no_embeddings"}
    assert [r.chunk_id for r in search.usable_vectors(vectors, "p", "m", 2).collect()] == ["c1"]
