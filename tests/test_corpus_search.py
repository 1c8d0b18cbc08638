"""Near-duplicates of a corpus, the block index and the inverted-file vectors against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.catalog.base import corpus_blocks, corpus_index
from textquarry.catalog.terms import benchmark_queries
from textquarry.operators import lexical, lexical_index, near_duplicates, vector_index, vectors
from textquarry.plans import index as plan
from textquarry.sources import sinks


def corpus(seed=3):
    """Clusters of near copies that share most tokens, exact copies, short and empty texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(14, 60))]
        for i in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
            rows.append((f"c{c:02d}-{i:02d}", rng.choice([" ", "\n", "-"]).join(words)))
    rows += [("short-a", "a b c"), ("short-b", "a b c"), ("none", None), ("empty", ""), ("long", " ".join(f"w{i}" for i in range(4000)))]
    rows += [(f"copy-{i}", rows[0][1]) for i in range(30)]
    rng.shuffle(rows)
    return rows


def plain_classes(rows, least=12, threshold=0.9):
    import re

    sets = [(i, frozenset(re.findall(r"[A-Za-z0-9_]+", t or ""))) for i, t in rows]
    links, root = Counter(), {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if len(s) >= least and len(t) >= least and len(s & t) / len(s | t) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i), links[i]) for i, s in sets}


@pytest.mark.parametrize("block_nodes", [512, 3])
def test_corpus_near_duplicates(spark, block_nodes):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)
    for name in ("node", "token", "tokens", "block", "links", "copies", "n", "at"):
        chunks = chunks.withColumn(name, F.lit("clash"))
    got = {tuple(r) for r in near_duplicates.corpus_near_duplicates(chunks, block_nodes=block_nodes).collect()}
    expected = plain_classes(rows)
    assert got == expected
    assert max(r[3] for r in got) >= 30


def test_no_chunks_have_no_duplicates(spark):
    none = spark.createDataFrame([], "chunk_id string, content string")
    assert near_duplicates.corpus_near_duplicates(none).collect() == []


def test_no_comparison_emits_pairs(spark):
    """300 sets that are all alike leave one row each and per unit, not their 44 850 pairs."""
    words = [f"t{i}" for i in range(60)]
    rows = [(f"c{i:03d}", " ".join([*words, f"own{i}"])) for i in range(300)]
    _, nodes = near_duplicates.token_nodes(spark.createDataFrame(rows, "chunk_id string, content string"))
    linked = near_duplicates.linked_nodes(nodes, 0.9, block_nodes=50)
    assert linked.groupBy("node").agg(F.sum("links").alias("n")).where("n <> 299").isEmpty()
    assert linked.count() <= 300 * 6 * 2


# ---- block index -------------------------------------------------------------


def search_rows(frame):
    return sorted((r.query_id, r.text_position, r.chunk_id, r.text_rank, round(r.matched_idf, 9), tuple(r.matched_terms)) for r in frame.collect())


def lexical_corpus(spark, tmp_path, seed=5, n=400):
    """Skewed terms, so that blocks differ; ties; a chunk without terms."""
    rng = random.Random(seed)
    words = [f"term{i}" for i in range(60)]
    rows = []
    for i in range(n):
        few = rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 40))
        rows.append(("r1" if i % 3 else "r2", f"f{i // 8}.txt", f"id{i:04d}", None, None, " ".join(few)))
    rows += [("r1", "same.txt", f"tie{i}", None, None, "term50 term51") for i in range(60)] + [("r1", "blank.txt", "blank", None, None, "  1 2 ")]
    chunks = spark.createDataFrame(rows, "repository_id string, path string, chunk_id string, parent_symbol string, symbol string, content string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    lexical.build_postings(lexical_index.numbered(chunks), ["segment", "slot"]).write.parquet(str(tmp_path / "postings"))
    postings = spark.read.parquet(str(tmp_path / "postings"))
    plan.write_lexical(str(tmp_path), "one", chunks, postings)
    read = [spark.read.parquet(str(tmp_path / name)).drop("run") for name in plan.LEXICAL_TABLES]
    asked = [(q, "r1" if q % 4 else "r2", " ".join(rng.sample(words, 4))) for q in range(30)] + [(90, "r1", "term50 term51"), (91, "r1", "unknown"), (92, "no such", "term1")]
    return chunks, postings, lexical_index.LexicalIndex(*read), spark.createDataFrame(asked, "query_id int, repository_id string, text string")


def test_block_search_equals_the_plain_search(spark, tmp_path):
    chunks, postings, index, queries = lexical_corpus(spark, tmp_path)
    rows = lexical.query_terms(queries)
    plain_stats = lexical.term_statistics(postings, chunks, rows)
    stats = lexical_index.stored_statistics(index, rows)
    assert sorted(map(tuple, stats.select(*plain_stats.columns).collect())) == sorted(map(tuple, plain_stats.collect()))
    for limit in (1, 5, 40, 1000):
        assert search_rows(lexical_index.block_search(index, stats, rows, limit)) == search_rows(lexical.lexical_search(postings, plain_stats, rows, limit))


def test_segments_that_cannot_rank_are_skipped(spark, tmp_path):
    _, _, index, queries = lexical_corpus(spark, tmp_path)
    rows = lexical.query_terms(queries)
    searchable = lexical.searchable_terms(lexical_index.stored_statistics(index, rows), rows).withColumn("bucket", lexical_index.term_bucket(F.col("term")))
    every = lexical_index.segment_bounds(index.blocks, searchable).count()
    kept = lexical_index.promising_segments(index.blocks, searchable, 5).count()
    assert 0 < kept < 0.6 * every


def test_a_search_reads_the_folders_of_its_terms_and_no_postings(spark, tmp_path):
    _, _, index, queries = lexical_corpus(spark, tmp_path)
    rows = lexical.query_terms(queries.where("query_id = 90"))
    stats = lexical_index.stored_statistics(index, rows)
    text = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in text and "tf_body" not in text
    searchable = lexical.searchable_terms(stats, rows).withColumn("bucket", lexical_index.term_bucket(F.col("term")))
    searchable.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    blocks = sinks.in_folders(index.blocks, "bucket", asked)
    bounds = lexical_index.segment_bounds(blocks, asked)
    executed = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in executed and "hits" not in executed
    assert blocks.select("bucket").distinct().count() <= 4 < index.blocks.select("bucket").distinct().count()


def test_stored_indexes_serve_the_search_of_the_catalog(spark, sf_dir):
    index, blocks, queries = corpus_index(spark, sf_dir), corpus_blocks(spark, sf_dir), benchmark_queries(spark, sf_dir)
    rows = lexical.query_terms(queries)
    plain = lexical.lexical_search(index.postings, lexical.term_statistics(index.postings, index.chunks, rows), rows, 40)
    assert search_rows(lexical_index.block_search(blocks, lexical_index.stored_statistics(blocks, rows), rows, 40)) == search_rows(plain)


# ---- inverted-file vectors ---------------------------------------------------


def clustered(spark, n=3000, width=32, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, width))
    rows = [(("big" if i % 3 else "small"), f"v{i:05d}", (centres[rng.integers(30)] + 0.5 * rng.standard_normal(width)).tolist()) for i in range(n)]
    rows += [("big", "zero", [0.0] * width), ("big", "null", None)]
    return spark.createDataFrame(rows, "repository_id string, chunk_id string, embedding array<double>")


def test_cells_cover_every_vector_and_all_probes_are_exact(spark):
    embeddings = clustered(spark)
    model = vector_index.train(embeddings, 32, cells=20)
    index = vector_index.VectorIndex(vector_index.build(embeddings, model).cache(), model)
    held = Counter(r.chunk_id for r in index.blocks.select(F.explode("rows").alias("r")).select("r.chunk_id").collect())
    assert set(held.values()) == {1} and len(held) == 3001
    queries = embeddings.where("chunk_id like 'v000%'").select(F.col("chunk_id").alias("query_id"), "repository_id", "embedding")
    exact = vectors.cosine_top_k(queries, embeddings.where("embedding IS NOT NULL AND chunk_id <> 'zero'"), 10)
    rows = lambda df: sorted((r.query_id, r.semantic_rank, r.chunk_id, r.score) for r in df.collect())
    assert rows(vector_index.ivf_top_k(queries, index, embeddings, 10, probes=20, refine=400)) == rows(exact)
    few = vector_index.ivf_top_k(queries, index, embeddings, 10, probes=3)
    assert vectors.recall(few, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert vector_index.read_share(queries, index, probes=3).agg(F.max("share")).first()[0] < 0.5
    row = model.first()
    assert row["probes"] <= 6  # the clusters are found when the model is fitted
    chosen = vector_index.ivf_top_k(queries, index, embeddings, 10)
    assert vectors.recall(chosen, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert row["refine"] * 10 < 0.2 * 1000


def test_vectors_of_nothing(spark):
    none = clustered(spark).where("false")
    model = vector_index.train(none, 32)
    index = vector_index.VectorIndex(vector_index.build(none, model), model)
    queries = clustered(spark).limit(3).select(F.col("chunk_id").alias("query_id"), "repository_id", "embedding")
    assert vector_index.ivf_top_k(queries, index, none, 5).collect() == []


def chunk_vectors(spark, tables):
    """Vectors of all chunks of the documents, with passages of the benchmark as queries."""
    index, asked = corpus_index(spark, tables), benchmark_queries(spark, tables)
    return index.embeddings.where("embedding IS NOT NULL"), plan.query_vectors(asked).withColumn("query_id", F.col("query_id").cast("string"))


def plain_vectors(spark, tables):
    """The table of vectors, which has no clusters, with every hundredth as a query."""
    rows = spark.read.parquet(f"{tables}/embeddings.parquet")
    embeddings = rows.select(F.lit("r").alias("repository_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return embeddings, embeddings.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@pytest.mark.parametrize("source", [chunk_vectors, plain_vectors])
@pytest.mark.parametrize("tables", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_stored_vectors(spark, source, tables):
    """Nine in ten of the exact hits, while under a fifth of the vectors are scored."""
    embeddings, queries = source(spark, tables)
    model = vector_index.train(embeddings, 64)
    index = vector_index.VectorIndex(vector_index.build(embeddings, model).cache(), model)
    exact = vectors.cosine_top_k(queries, embeddings, 10)
    found = vector_index.ivf_top_k(queries, index, embeddings, 10)
    assert vectors.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    scored = model.first()["refine"] * 10
    print(tables, source.__name__, model.first()["cells"], model.first()["probes"], scored, embeddings.count())
    assert scored < 0.2 * embeddings.count()
