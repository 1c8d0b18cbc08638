"""The block index in stretches: built without a shuffle, searched one row per stretch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import lexical, lexical_index


def corpus(spark, tmp_path):
    """Interleaved repositories, counts over one and two bytes, a chunk without terms."""
    words = ["alpha", "beta", "gamma", "delta", "rare"]
    rows = []
    for i in range(120):
        text = " ".join(words[k] for k in range(4) for _ in range((i * (k + 3)) % 7)) + (" rare" * 300 if i == 50 else "")
        rows.append(("r1" if i % 3 else "r2", f"f{i}.txt", f"id{i:03d}", None, None, text if i else " 1 "))
    chunks = spark.createDataFrame(rows, "repository_id string, path string, chunk_id string, parent_symbol string, symbol string, content string")
    chunks.coalesce(2).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    lexical.packed_postings(lexical_index.numbered(chunks), ["segment", "slot"]).write.parquet(str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    index = lexical_index.LexicalIndex(
        lexical_index.build_blocks(postings), lexical_index.places(postings), lexical_index.term_counts(postings),
        lexical_index.repository_counts(chunks, postings),
    )
    asked = [(1, "r1", "alpha rare"), (2, "r2", "beta"), (3, "r1", "gamma delta alpha")]
    return chunks, postings, index, lexical.query_terms(spark.createDataFrame(asked, "query_id int, repository_id string, text string"))


def test_blocks_are_made_without_a_shuffle(spark, tmp_path):
    _, _, index, _ = corpus(spark, tmp_path)
    assert "Exchange" not in index.blocks._jdf.queryExecution().executedPlan().toString()


def test_every_matching_chunk_is_counted_once_and_within_its_bound(spark, tmp_path):
    chunks, postings, index, rows = corpus(spark, tmp_path)
    stats = lexical_index.stored_statistics(index, rows).withColumn("informative", F.lit(True))
    searchable = lexical.searchable_terms(stats, rows).withColumn("bucket", lexical_index.term_bucket(F.col("term")))
    hits = lexical.lexical_search(postings, stats, rows, 1000)
    wanted = sorted(map(tuple, hits.groupBy("query_id").agg(F.count("*"), F.max("text_rank")).collect()))
    assert sorted(map(tuple, lexical_index.chunks_within_bounds(index, searchable).collect())) == wanted
    found = lexical_index.block_search(index, stats, rows, 7).select("query_id", "chunk_id", "text_rank", "text_position").collect()
    first = hits.where("text_position <= 7").select("query_id", "chunk_id", "text_rank", "text_position").collect()
    assert sorted(found) == sorted(first)


@pytest.mark.parametrize("cut", [1, 7, 40])
def test_a_stretch_may_come_in_parts(cut):
    """Batches end anywhere; the parts of a stretch in one task become one row for a term."""
    count = pa.struct([("term", pa.string()), ("tf_names", pa.int64()), ("tf_body", pa.int64())])
    rows = pa.record_batch({
        "repository_id": pa.array(["r"] * 40),
        "segment": pa.array(np.arange(40) // 16 + lexical_index.STRETCH_SEGMENTS - 1),
        "slot": pa.array(np.arange(40) % 16, pa.int32()),
        "chunk_terms": pa.array([70_000] * 40, pa.int32()),
        "terms": pa.array([[{"term": "a", "tf_names": 0, "tf_body": i * 10}] for i in range(40)], pa.list_(count)),
    })
    batches = [rows.slice(at, cut) for at in range(0, 40, cut)]
    made = pa.Table.from_batches(lexical_index._stretches(iter(batches))).to_pylist()
    assert [(b["term"], b["stretch"], len(b["hits"]) // 2) for b in made] == [("a", 0, 16), ("a", 1, 24)]
    assert lexical_index._counts(made[1]["hit_bodies"], 24).tolist() == [i * 10 for i in range(16, 40)]
    assert lexical_index._counts(made[0]["hit_lengths"], 16).tolist() == [70_000] * 16 and made[0]["hit_names"] == b""
