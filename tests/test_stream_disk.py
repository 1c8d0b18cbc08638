"""What a streamed index leaves and moves: its tables alone, and of postings their counts."""

from pyspark.sql import functions as F

from textquarry.session import checkpoint_dir, cut_lineage, tables_dropped
from textquarry.sources import sinks
from textquarry.streaming import jobs

KIND = "repository_id string, path string, sha string, type string, size long, content string, pos long, version long"


def folders(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in system.listStatus(folder)} if system.exists(folder) else set()


def deliver(spark, source, target, rows):
    frame = spark.createDataFrame([("r", p, f"{p}{v}", "blob", len(t), t, i, v) for i, (p, t, v) in enumerate(rows)], KIND)
    frame.write.mode("append").parquet(source)
    jobs.index_stream(spark.readStream.schema(frame.schema).parquet(source), target, f"{target}-progress").awaitTermination()


def test_batches_leave_no_tables_and_counts_stay_right(spark, tmp_path):
    tables = f"{checkpoint_dir(spark)}/tables"
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    before = folders(spark, tables)
    deliver(spark, source, target, [("a.txt", "alpha beta\n", 1), ("b.txt", "beta gamma\n", 1), ("c.txt", "12\n", 1), ("e.txt", "", 1)])
    deliver(spark, source, target, [("a.txt", "alpha delta\n", 2), ("b.txt", "late\n", 0), ("c.txt", "", 2)])
    assert folders(spark, tables) == before
    live = jobs.live_index(spark, target)
    counts = {r.term: r.df for r in live["term_counts"].groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    names = live["postings"].groupBy("term").count()
    assert counts == {r.term: r["count"] for r in names.collect()} and {"alpha", "delta", "gamma"} <= set(counts) and "late" not in counts
    totals = live["repository_counts"].agg(F.sum("chunks"), F.sum("lexical_chunks")).first()
    assert tuple(totals) == (live["chunks"].count(), live["postings"].where("tf_body > 0").select("chunk_id").distinct().count())


def test_wide_columns_stay_where_they_are_read(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    deliver(spark, source, target, [("a.txt", "alpha beta\n", 1)])
    deliver(spark, source, target, [("a.txt", "alpha gamma\n", 2)])
    taken = {"postings": [F.size("terms").alias("n")], "embeddings": ["chunk_id", F.size("embedding").alias("width")]}
    live = jobs.live_index(spark, target, packed=True, columns=taken)
    terms = jobs.live_index(spark, target)["postings"].count()
    assert [r.n for r in live["postings"].collect()] == [terms] and [r.width for r in live["embeddings"].collect()] == [64]
    text = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "run#" in text(live["embeddings"]) and "batch-000000000001" in text(live["embeddings"])  # the only run with a current file
    plan = sinks.of_keys(spark.range(9), spark.range(4), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_tables_go_with_their_scope(spark):
    with tables_dropped(spark):
        kept = cut_lineage(spark.range(3))
        assert kept.count() == 3
        path = kept.inputFiles()[0]
    assert not sinks.exists(spark, path)
    assert sinks.exists(spark, cut_lineage(spark.range(3)).inputFiles()[0])


def test_merged_postings_are_the_same_and_move_narrow(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "index")
    deliver(spark, source, target, [("a.txt", "alpha beta alpha\n", 1), ("b.txt", "gamma\n", 1)])
    deliver(spark, source, target, [("b.txt", "gamma delta_x deltaY\n", 2), ("c.txt", "1 2\n", 1)])
    read = lambda: [r for r in jobs.live_index(spark, target, packed=True)["postings"].orderBy("chunk_id").collect()]
    before, kind = read(), jobs.live_index(spark, target, packed=True)["postings"].schema
    jobs.merge_runs(spark, target)
    assert read() == before and jobs.live_index(spark, target, packed=True)["postings"].schema == kind
    stored = spark.createDataFrame([("r", "c", 1, [("t", 1, 2)]), ("r", "d", 0, [])], "repository_id string, chunk_id string, n int, terms array<struct<term:string,tf_names:bigint,tf_body:bigint>>")
    there = stored.select("chunk_id", *jobs._narrow(F.col("terms"))).select("chunk_id", jobs._widened().alias("terms"))
    assert sorted(map(tuple, there.collect())) == sorted(map(tuple, stored.select("chunk_id", "terms").collect()))
