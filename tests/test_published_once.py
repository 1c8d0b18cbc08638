"""Publishing: texts are shuffled once, blocks travel in bundles, counts come from the blocks."""

from pyspark.sql import functions as F

from test_stretches import corpus

from textquarry.operators import filters, lexical_index
from textquarry.plans import index as plan


def test_files_dealt_by_repository_and_place_stay_there_when_copies_are_dropped(spark):
    rows = [("r", "b", 1), ("r", "b", 2), ("r", "c", 3), ("s", "b", 1), ("r", None, 4), (None, "b", 5)]
    dealt = spark.createDataFrame(rows, "repository_id string, sha string, pos long").repartition("repository_id", "pos")
    kept = filters.dedupe_by_blob(dealt.withColumn("content", F.concat("repository_id", "sha")))
    plan_text = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [("r", "b", 2, "rb"), ("r", "c", 3, "rc"), ("s", "b", 1, "sb")]
    wide, narrow = plan_text.count("REPARTITION_BY_COL"), plan_text.count("ENSURE_REQUIREMENTS")
    assert wide == 2 and narrow == 2 and "SortMergeJoin" not in plan_text  # both sides are dealt; two aggregates


def test_chunks_are_cut_from_the_written_files(spark, tmp_path):
    kind = "repository_id string, path string, sha string, type string, size long, pos long, content string"
    files = [("r", "a.txt", "x", "blob", 4, 1, "one\n"), ("r", "b.py", "y", "blob", 20, 2, "def f():\n    return 1\n")]
    built = plan.build_index(spark.createDataFrame(files, kind))
    wanted = sorted(map(tuple, built.chunks.collect()))
    built.files.write.parquet(str(tmp_path / "files"))
    assert len(wanted) == 2 and sorted(map(tuple, built.cut(spark.read.parquet(str(tmp_path / "files"))).collect())) == wanted


def test_stored_blocks_are_the_blocks_and_count_their_terms(spark, tmp_path):
    _, postings, index, _ = corpus(spark, tmp_path)
    stored = lexical_index.stored_blocks(postings)
    assert stored.schema.names == index.blocks.schema.names
    read = lambda rows: sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.collect())
    assert read(stored) == read(index.blocks)
    counted = lexical_index.block_counts(stored).groupBy("repository_id", "term").agg(F.sum("df"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, index.term_counts.collect()))
