"""Words, Jaccard join, substring deduplication and language-model scores against plain versions."""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import common  # noqa: E402

from textquarry.llm import jaccard, lm, substring  # noqa: E402
from textquarry.llm.components import components  # noqa: E402
from textquarry.llm.words import parts, sequences  # noqa: E402

ROWS = common.corpus()


def test_words_match_the_pattern():
    texts = [t for _, t in ROWS] + ["\x1cno gap\x85here", "a\x0bb\x0cc"]
    found, hashes = [], {}
    for _, _, words in parts(pa.array(texts, pa.string()), most=3000):
        raw = words.data.tobytes()
        for a, b in zip(words.offsets[:-1], words.offsets[1:]):
            found.append([raw[s:e].decode() for s, e in zip(words.starts[a:b], words.stops[a:b])])
        for s, e, h in zip(words.starts, words.stops, words.hashes()):
            assert hashes.setdefault(raw[s:e], h) == h
    assert found == [common.words_of(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_sequence_hashes_depend_on_content_and_order():
    h = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    for n in (1, 2, 3, 5, 10, 20):
        twice = sequences(np.concatenate([h, h]), n)
        assert (twice[: 60 - n + 1] == twice[60:]).all() and len(set(twice[:60].tolist())) == 60
    assert sequences(h[:2], 2)[0] != sequences(h[:2][::-1].copy(), 2)[0]


@pytest.mark.parametrize("orders", [1, 3])
def test_jaccard_components(spark, orders):
    got = jaccard.join_components(common.documents(spark, ROWS), orders=orders, bits=12, block_tokens=500).collect()
    expected = common.classes(ROWS)
    assert len(got) == len(ROWS)
    sizes = {d: len(common.shingles(t)) for d, t in ROWS}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, sizes[d], c) for d, c in expected.items()}


@pytest.mark.parametrize("compare_tokens", [100, 100_000])
def test_jaccard_links_within_one_component_are_all_counted(spark, compare_tokens):
    base = [f"w{i}" for i in range(60)]
    near = [(2000 + i, " ".join([*base[:i], "edit", *base[i + 1 :]])) for i in range(0, 60, 2)]
    chain = [(3000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 50))) for i in range(12)]
    rows = [*ROWS, *near, (2100, near[3][1]), *chain, (None, chain[5][1])]
    sets = [common.shingles(t) for _, t in rows]
    linked = lambda s, t: bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)
    degrees = [sum(linked(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)]
    found = jaccard.join_links(common.documents(spark, rows), bits=12, block_tokens=500, compare_tokens=compare_tokens)
    got = Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in found.collect())
    assert got == Counter((d, len(s), k) for (d, _), s, k in zip(rows, sets, degrees))
    assert max(degrees) >= 20

    nodes, least = {s: 0 for s in sets if s}, {}
    for (d, _), s in zip(rows, sets):
        if s:
            nodes[s] += 1
            least[s] = d if least.get(s) is None else min(least[s], d if d is not None else least[s])
    distinct = list(nodes)
    expected = {
        (frozenset([least[s], least[t]]), frozenset([(least[s], nodes[s]), (least[t], nodes[t])]))
        for i, s in enumerate(distinct) for t in distinct[:i] if linked(s, t)
    }
    pairs = jaccard.linked_pairs(common.documents(spark, rows), bits=12, block_tokens=500, compare_tokens=compare_tokens).collect()
    assert len(pairs) == len(expected)
    assert {(frozenset([r["a"], r["b"]]), frozenset([(r["a"], r["a_rows"]), (r["b"], r["b_rows"])])) for r in pairs} == expected


def test_jaccard_without_ids_or_rows(spark):
    rows = [(None, "a b c d e f"), (None, "q"), (3, "a b c d e f"), (4, None)]
    got = {tuple(r) for r in jaccard.join_components(common.documents(spark, rows)).collect()}
    assert got == {(None, 2, 3), (None, 1, None), (3, 2, 3), (4, 0, 4)}
    assert jaccard.join_components(common.documents(spark, [])).collect() == []


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 52), (52, 50)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50, 52: 50}


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 22), (2000, 900)])
def test_repeats_are_cut(spark, sizes):
    rows = ROWS + [(None, ROWS[0][1]), (None, "z " * 50)]
    got = substring.remove_repeats(common.documents(spark, rows), chunk_bytes=sizes[0], block_bytes=sizes[1]).collect()
    expected = common.without_repeats(rows)
    found = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)
    assert found == Counter((d, *expected[d, t]) for d, t in rows)
    texts = {d: common.words_of(t) for d, t in rows}
    for r in got:
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= 20
            own = texts[r["doc_id"]][f["start"] : f["start"] + f["length"]] if r["doc_id"] is not None else None
            if own is not None and f["reference_id"] is not None:
                assert texts[f["reference_id"]][f["reference_start"] : f["reference_start"] + f["length"]] == own
            covered |= set(range(f["start"], f["start"] + f["length"]))
        assert len(covered) == r["n_removed"]


def test_repeats_of_nothing(spark):
    assert substring.remove_repeats(common.documents(spark, [])).collect() == []


def plain_scores(rows, order: int, m: float):
    trained = [t for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    pad = ["<s>"] * (order - 1)
    counts, contexts = Counter(), Counter()
    for t in trained:
        tokens = pad + common.words_of(t, lower=True) + ["</s>"]
        for i in range(order - 1, len(tokens)):
            for n in range(1, order + 1):
                counts[tuple(tokens[i - n + 1 : i + 1])] += 1
                contexts[tuple(tokens[i - n + 1 : i])] += 1
    unigrams = {g: c for g, c in counts.items() if len(g) == 1}
    total, distinct = sum(unigrams.values()), len(unigrams)
    out = []
    for d, t in rows:
        tokens = pad + common.words_of(t, lower=True) + ["</s>"]
        base = score = known = 0
        for i in range(order - 1, len(tokens)):
            c = counts[(tokens[i],)]
            known += c > 0
            p = (c + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                gram = tuple(tokens[i - n + 1 : i + 1])
                p = (counts[gram] + m * p) / (contexts[gram[:-1]] + m)
            score += math.log10(p)
        out.append((d, len(tokens) - order + 1, known, total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("order,chunk", [(2, 1 << 22), (3, 1500)])
def test_scores_of_the_automaton(spark, order, chunk):
    rows = ROWS + [(None, "no id here")]
    got = lm.score(common.documents(spark, rows), order=order, m=3.0, chunk_bytes=chunk, block_bytes=1000).collect()
    found = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert sorted(found, key=str) == plain_scores(rows, order, 3.0)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0) for r in got)


def test_scores_of_nothing(spark):
    assert lm.score(common.documents(spark, [])).collect() == []


def test_held_out_text_is_better_explained_than_by_single_words(spark, sf_dir):
    r = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_documents_are_shuffled_once_for_scoring(spark, sf_dir):
    plan = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan
