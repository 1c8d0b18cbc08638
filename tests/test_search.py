import itertools
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import vectors as vector_functions
from textquarry.operators import context, fusion, lexical, vectors
from textquarry.settings import ContextSettings

POOL = (
    "query_id string, chunk_id string, score double, semantic_rank int, text_rank double, coverage double, "
    "matched_terms array<string>, identifiers array<string>, path string, symbol string, parent_symbol string, "
    "language string, content string"
)


def pool(spark, rows):
    return spark.createDataFrame(rows, POOL)


def flat_pool(n, shift=0.0, scale=1.0):
    return [
        ("q", f"c{i:02d}", (0.7 - 0.002 * i) * scale + shift, i + 1, 0.0, 0.0, [], [], f"f{i}.py", None, None, "text", f"words {i}")
        for i in range(n)
    ]


def test_normal_quantile(spark):
    normal = statistics.NormalDist()
    probabilities = [0.001, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.93, 0.999]
    rows = spark.createDataFrame([(p,) for p in probabilities], "p double")
    for row in rows.select("p", vector_functions.normal_quantile(F.col("p")).alias("z")).collect():
        assert row.z == pytest.approx(normal.inv_cdf(row.p), abs=1e-12)


def test_excess_matches_definition_and_is_scale_free(spark):
    normal = statistics.NormalDist()
    for shift, scale in ((0.0, 1.0), (0.3, 0.1)):
        rows = fusion.semantic_excess(fusion.exact_signals(pool(spark, flat_pool(20, shift, scale)))).orderBy("semantic_rank").collect()
        scores = [0.7 - 0.002 * i for i in range(20)]
        centre, spread = statistics.fmean(scores[1:]), statistics.pstdev(scores[1:])
        for k, row in enumerate(rows, start=1):
            expected = (scores[k - 1] - centre) / spread - max(normal.inv_cdf((20 - k + 0.625) / 20.25), 0)
            assert row.semantic_excess == pytest.approx(expected, abs=1e-5)


def test_small_pool_has_no_excess(spark):
    rows = fusion.semantic_excess(fusion.exact_signals(pool(spark, flat_pool(7)))).collect()
    assert all(row.semantic_excess is None for row in rows)


def test_symbol_beats_path_and_low_value_takes_no_position(spark):
    rows = [
        ("q", "a", 0.9, 1, 0.0, 0.0, [], ["useMemo", "src/a.py"], "src/a.py", "use_memo", None, "python", "# only"),
        ("q", "b", 0.8, 2, 0.0, 0.0, [], ["useMemo", "src/a.py"], "src/a.py", None, None, "python", "x = useMemo"),
    ]
    out = {r.chunk_id: r for r in fusion.rrf(fusion.list_ranks(fusion.exact_signals(pool(spark, rows)))).collect()}
    assert (out["a"].named_as, out["b"].named_as) == ("symbol", "path")
    assert out["a"].low_value and out["a"].fused == 0.0
    assert out["b"].fused == pytest.approx(3 / 61, abs=1e-8)


def test_near_duplicates_compare_with_kept_only(spark):
    words = [f"w{i}" for i in range(40)]
    variants = [" ".join(words), " ".join(words[:38] + ["x", "y"]), " ".join(words[:36] + ["x", "y", "z", "v"]), "tiny copy", "tiny  copy"]
    rows = [("q", f"c{i}", 0.9 - i / 10, i + 1, 0.0, 0.0, [], [], "f", None, None, "text", v) for i, v in enumerate(variants)]
    ranked = fusion.rrf(fusion.list_ranks(fusion.exact_signals(pool(spark, rows))))
    kept = {r.chunk_id for r in fusion.dedupe_near(fusion.dedupe_exact(ranked)).collect()}

    def brute():
        out = []
        for i, v in enumerate(variants):
            tokens = set(v.split())
            if " ".join(v.split()) in {" ".join(variants[j].split()) for j in out}:
                continue
            if len(tokens) >= 12 and any(
                len(set(variants[j].split())) >= 12
                and len(tokens & set(variants[j].split())) / len(tokens | set(variants[j].split())) >= 0.9
                for j in out
            ):
                continue
            out.append(i)
        return {f"c{i}" for i in out}

    assert kept == brute() == {"c0", "c2", "c3"}


def test_strength(spark):
    columns = "query_id string, evidence_candidates bigint, exact_matches bigint, strong_lexical bigint, corroborated bigint, semantic_excess double"
    rows = [("a", 0, 1, 1, 1, 9.0), ("b", 3, 1, 0, 0, None), ("c", 3, 0, 1, 1, None), ("d", 3, 0, 1, 0, 0.1), ("e", 3, 0, 0, 0, 0.3), ("f", 3, 0, 0, 0, 0.6), ("g", 3, 0, 0, 0, -0.1)]
    got = {r.query_id: r.strength for r in fusion.evidence_strength(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"a": "none", "b": "useful", "c": "useful", "d": "weak", "e": "weak", "f": "useful", "g": "none"}


def test_exact_cosine_matches_brute_force_with_a_hot_repository(spark):
    generator = np.random.default_rng(3)
    corpus = generator.standard_normal((900, 16))
    corpus[10] = corpus[20]  # a tie
    queries = generator.standard_normal((7, 16))
    c = spark.createDataFrame([(f"c{i:03d}", "r" if i % 3 else "s", v.tolist()) for i, v in enumerate(corpus)], "chunk_id string, repository_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", "r", v.tolist()) for i, v in enumerate(queries)], "query_id string, repository_id string, embedding array<double>")
    got = {}
    for row in vectors.cosine_top_k(q, c, 9, salts=4, block_rows=64).collect():
        got.setdefault(row.query_id, {})[row.semantic_rank] = row.chunk_id
    for i, v in enumerate(queries):
        scores = [(-round(float(corpus[j] @ v / np.linalg.norm(corpus[j]) / np.linalg.norm(v)), 9), f"c{j:03d}") for j in range(900) if j % 3]
        expected = [name for _, name in sorted(scores)[:9]]
        assert [got[f"q{i}"][r] for r in range(1, 10)] == expected


def test_term_missing_everywhere_still_weighs(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "r", f"f{i}.py", None, None, "python", text) for i, text in enumerate(["stripe alpha", "beta", "gamma", "delta"])],
        "chunk_id string, repository_id string, path string, symbol string, parent_symbol string, language string, content string",
    )
    asked = lexical.query_terms(spark.createDataFrame([("q", "r", "stripe webhooks")], "query_id string, repository_id string, text string"))
    postings = lexical.build_postings(chunks)
    stats = lexical.term_statistics(postings, chunks, asked)
    hits = lexical.coverage(lexical.lexical_search(postings, stats, asked, 10), stats, asked).collect()
    assert [h.chunk_id for h in hits] == ["c0"]
    idf = {r.term: r.idf for r in stats.collect()}
    assert hits[0].coverage == pytest.approx(idf["stripe"] / (idf["stripe"] + idf["webhooks"]), abs=1e-8)


def ranked(spark, chars, paths=None):
    rows = [
        ("q", "r", f"c{i}", i + 1, (paths or [f"f{i}" for i in range(len(chars))])[i], i + 1, None, "symbol", 1.0, None, False, "x" * n)
        for i, n in enumerate(chars)
    ]
    return spark.createDataFrame(
        rows,
        "query_id string, repository_id string, chunk_id string, rank int, path string, semantic_rank int, lexical_rank int, "
        "exact_match string, coverage double, semantic_excess double, low_value boolean, content string",
    )


def walk(chars, settings):
    left, picked = settings.max_chars, []
    for i, n in enumerate(chars):
        if len(picked) >= settings.max_sources:
            continue
        if n + settings.source_overhead <= left:
            picked.append(i)
            left -= n + settings.source_overhead
        elif not picked and left - settings.source_overhead >= settings.min_useful_chars:
            picked.append(i)
            left -= left - settings.source_overhead + len(context.TRUNCATED) + settings.source_overhead
    return [f"c{i}" for i in picked]


@pytest.mark.parametrize("chars", list(itertools.permutations([100, 900, 2_500, 400]))[::5] + [(5_000, 10, 10)])
def test_packing_equals_walk(spark, chars):
    settings = ContextSettings(max_chars=2_000, max_sources=3)
    rows = context.pack_budget(context.diversify(ranked(spark, chars)), settings).where("label is not null").orderBy("label").collect()
    assert [r.chunk_id for r in rows] == walk(chars, settings)


def test_fourth_chunk_of_a_file_waits(spark):
    rows = context.diversify(ranked(spark, [10] * 6, ["a", "a", "a", "a", "b", "a"])).orderBy("selection_order").collect()
    assert [r.chunk_id for r in rows] == ["c0", "c1", "c2", "c4", "c3", "c5"]
