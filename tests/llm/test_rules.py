"""Quality, language, chat, search, mixing and packing against plain versions."""

from __future__ import annotations

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import common  # noqa: E402

from textquarry.llm import chat, langid, mixing, packing, quality, topk  # noqa: E402
from textquarry.llm.tokens import Encoder  # noqa: E402

ROWS = common.corpus()
PATH = public_tokenizers.path("byte_bpe_50k.json")


def base_measures(text):
    text = text or ""
    words = common.words_of(text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if common.words_of(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def labels_of(spark, rows):
    return spark.createDataFrame([(d, int(d % 3 > 0), 0) for d, _ in rows if d is not None and d % 2], "doc_id bigint, quality int, toxic int")


def test_base_measures(spark):
    rows = ROWS + [(920, "a a a a a\nb\n \nb\nb \n#<é>"), (None, "x y z x y z")]
    got = quality.quality_rules(common.documents(spark, rows), labels_of(spark, rows)).collect()
    found = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got)
    expected = Counter()
    for d, t in rows:
        m = base_measures(t)
        expected[(d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert found == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_on_labelled_documents_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    judged = quality.quality_rules(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.1


def test_resampling_takes_the_top_k(spark):
    rows = ROWS + [(None, "no id"), (None, None)]
    got = quality.importance_resample(common.documents(spark, rows), labels_of(spark, rows), share=0.4).collect()
    k = round(0.4 * len(rows))
    ranked = sorted(got, key=lambda r: -r["gumbel_key"])
    assert {r["gumbel_key"] for r in got if r["kept"]} == {r["gumbel_key"] for r in ranked[:k]}
    again = quality.importance_resample(common.documents(spark, rows), labels_of(spark, rows), share=0.4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_of_nothing(spark):
    empty = common.documents(spark, [])
    labels = labels_of(spark, ROWS)
    assert quality.quality_rules(empty, labels).collect() == []
    assert quality.importance_resample(empty, labels).collect() == []
    rows = quality.quality_rules(common.documents(spark, ROWS), labels.filter("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


@pytest.mark.parametrize("k", [1, 7, 100, 500])
def test_kth_largest(spark, k):
    rng = np.random.default_rng(k)
    values = np.concatenate([rng.normal(0, 1e6, 400), np.full(100, 3.25)]).tolist()
    assert quality.kth_largest(spark.createDataFrame([(v,) for v in values], "key double"), k, steps=8) == sorted(values, reverse=True)[k - 1]


LANGUAGES = ("de", "en", "es", "fr")


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter("doc_id % 2 = 0"), LANGUAGES)
    evidence = docs.filter("doc_id % 2 = 1").select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    found = langid.identify(evidence, model, LANGUAGES).join(docs, "doc_id").select("lang", "language", "accepted").collect()
    assert np.mean([r["lang"] == r["language"] for r in found]) > 0.97
    assert np.mean([r["accepted"] for r in found]) > 0.97


def test_evidence_of_declaration_and_host(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, LANGUAGES)
    some = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.concat(F.col("lang"), F.lit(".example."), F.col("lang")).alias("host"))
    odd = spark.createDataFrame(
        [(-1, "la", "fr-FR", "fr.example.fr"), (-2, "la", "es", "es.example.es"), (-3, None, "en", "en.example.en"), (-4, "", None, None),
         (-5, "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14" * 9, None, None), (None, "de la", "xx", "fr.example.fr")],
        some.schema,
    )
    found = {r["doc_id"]: r for r in langid.identify(some.unionByName(odd), model, LANGUAGES).collect()}
    assert found[-1]["language"] == "fr" and found[-2]["language"] == "es" and found[None]["language"] == "fr"
    assert all(found[i]["language"] == "und" and not found[i]["accepted"] for i in (-3, -4, -5))
    assert langid.identify(some.limit(0), model, LANGUAGES).collect() == []


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree_id bigint, message_id bigint, parent_id bigint, role string, text string, score double")


def test_reply_paths_and_format(spark):
    rows = [
        (1, 1, None, "user", "hi <|end|>\n &lt; [INST]", 1.0), (1, 2, 1, "assistant", None, 5.0), (1, 3, 1, "assistant", "bé\\tter", 9.0),
        (1, 4, 3, "user", "", None), (1, 5, 3, None, "<|assistant|>\n", 9.0), (2, 1, 77, "assistant", "orphan", 0.0),
        (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (None, 1, None, "user", "no tree", 0.0), (None, 2, 1, "assistant", "x", 0.0),
        *[(4, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"turn {i}", 0.0) for i in range(37)],
    ]
    messages = tree(spark, rows)
    paths = common.grouped(((r["tree_id"], r["rank"]), (r["position"], r["message_id"])) for r in chat.reply_paths(messages).collect())
    found = {k: [m for _, m in sorted(v)] for k, v in paths.items()}
    assert found == {
        (1, 1): [1, 3, 5], (1, 2): [1, 3, 4], (1, 3): [1, 2], (2, 1): [1], (None, 1): [1, 2], (4, 1): list(range(37)),
    }
    out = chat.format_paths(chat.reply_paths(messages, best=1), messages)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    by_tree = {r["tree_id"]: r for r in out.collect()}
    said = {(t, m): (role or "", text or "") for t, m, _, role, text, _ in rows}
    for t, ids in ((1, [1, 3, 5]), (2, [1]), (None, [1, 2]), (4, list(range(37)))):
        turns = [said[t, m] for m in ids]
        assert [tuple(x) for x in by_tree[t]["turns"]] == turns
        assert by_tree[t]["masked"] == "".join(text for role, text in turns if role == "assistant")
    assert set(by_tree) == {1, 2, 4, None}
    assert chat.reply_paths(messages.filter("false")).collect() == []


def test_chat_stays_in_the_engine(spark):
    messages = tree(spark, [(1, 1, None, "user", "a", 0.0)])
    plan = chat.format_paths(chat.reply_paths(messages), messages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 0.1, (150, 6)).astype(np.float32)
    data[10:20] = data[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(200, None), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (500, [float("inf")] + [0.0] * 5), (600, [0.0] * 6), (700, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<float>").withColumn("shard", F.lit("clash"))
    vectors = vectors.withColumn("vector", topk.quantised(F.col("embedding")))
    queries = vectors.filter("id % 10 = 0")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors, queries, k=5, shard_rows=20, query_rows=4).collect()}
    ints = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if i not in (200, 300, 400, 500)}
    expected = {}
    for q in (i for i in ints if i % 10 == 0):
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored)}
    assert got == expected
    assert topk.top_k(vectors.filter("false"), queries).collect() == []


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in stopped)
        whole = sum(weight[s] for s in order if s not in stopped)
        share = {s: 3 * sizes[s] if s in stopped else free * weight[s] / whole for s in order}
        over = {s for s in order if s not in stopped and share[s] > 3 * sizes[s]}
        if not over:
            return share
        stopped |= over


def test_mix(spark):
    rng = random.Random(2)
    names = [None, "a", "B", "ä", "z", "\U0001f600", ""]
    rows = [(i, names[rng.choice([0, 1, 1, 1, 1, 2, 3, 4, 5, 6])], rng.choice([0, 1, 5, 40, 300])) for i in range(600)]
    rows += [(7, "a", 40), (None, "a", 5), (9999, "tiny", 9), (9998, "none", 0), (9997, "long", 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumn("bucket", F.lit("clash")).repartition(3)
    got = mixing.mix(docs, block_words=8).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    target = plain_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == sum(p["words"] * p["times"] for p in r["parts"] or [])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(40, 0.03 * target[s]), (s, taken[s], target[s])
    assert sorted(map(str, mixing.mix(docs.repartition(5), block_words=8).select("doc_id", "size", "taken").filter("doc_id <> 7").collect())) == sorted(
        str(r) for r in mixing.mix(docs, block_words=8).select("doc_id", "size", "taken").filter("doc_id <> 7").collect()
    )
    assert mixing.mix(docs.filter("false")).collect() == []


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("bigint").alias("n"))
        got = [r["i"] for r in mixing.permuted(rows, "i", F.lit("key"), "n", 3).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_word_count(spark):
    docs = spark.createDataFrame(ROWS + [(None, "\x0ba\x0cb\x1c \r\n")], "doc_id bigint, text string")
    assert all(r["n"] == len(common.words_of(r["text"])) for r in docs.select("text", mixing.word_count(F.col("text")).alias("n")).collect())


def test_encoder_gives_the_tokenizers_ids():
    odd = [
        "", " ", "  two  spaces ", "end \n", "a \tb", "it's <|endoftext|> here", "日本語 текст 😀 x", "\x85 a\xa0 b", " lead", "tab\t x", "x  y", "a\x1c b",
        "don't they'LL 123abc 4.5e6 ... !!", "\n\n  \n", "größer\nnaïve Œuvre", "<|endoftext|>", "word\r\nnext", "a  b", "ſ's x's",
    ]
    texts = odd + [t or "" for _, t in ROWS]
    tokenizer = Tokenizer.from_file(PATH)
    encoder = Encoder(PATH, most_bytes=10_000)
    for _ in range(2):
        ids, bounds = encoder.encode(texts)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    rows = ROWS + [(None, "no id"), (None, None)]
    docs = common.documents(spark, rows)
    pieces = packing.token_pieces(docs, PATH, capacity=64)
    got = packing.pack(pieces, capacity=64, region_pieces=120, islands=3, epochs=3).collect()
    tokenizer = Tokenizer.from_file(PATH)
    lengths = Counter()
    for d, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        first = n % 64 or 64
        for i, start in enumerate([0, *range(first, n, 64)]):
            lengths[d, i, start, first if i == 0 else 64] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == lengths
    by = common.grouped((r["sequence_id"], (r["offset"], r["length"])) for r in got)
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    fewest = -(-sum(r["length"] for r in got) // 64)
    assert len(by) <= fewest + 2 * (1 + len(got) // 120)
    assert packing.pack(pieces.filter("false")).collect() == []


def test_islands_improve_on_best_fit():
    rng = np.random.default_rng(1)
    lengths = [int(x) for x in rng.choice([26, 27, 28, 35, 36, 37, 49, 50, 51], 120)]
    fewest = -(-sum(lengths) // 100)
    bins, fills = [], []
    packing.best_fit(bins, fills, sorted(range(120), key=lambda i: -lengths[i]), lengths, 100)
    best = packing.evolve(lengths, 100, [], np.random.default_rng(2), 8, 30)
    assert sorted(i for b in best[0] for i in b) == list(range(120))
    assert all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(*best))
    assert fewest <= len(best[1]) <= len(fills)
