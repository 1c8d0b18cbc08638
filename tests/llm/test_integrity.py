"""Dataset manifest, token alignment and line deduplication against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import common  # noqa: E402

from textquarry.llm import alignment, lines, merkle  # noqa: E402
from textquarry.llm.tokens import _byte_alphabet  # noqa: E402

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ROWS = common.corpus()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_fill_the_array_and_keep_subtrees_together(levels):
    places = [merkle.address(d, np.arange(3**d), levels) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    assert places[0][0] == 0
    half = levels // 2
    if half:
        upper = np.concatenate(places[:half])
        assert upper.max() == merkle.tree_size(half) - 1
        lower = merkle.tree_size(levels - half)
        for i in range(3**half):
            inside = np.concatenate([p[i * 3 ** (d - half) : (i + 1) * 3 ** (d - half)] for d, p in enumerate(places) if d >= half])
            assert inside.max() - inside.min() == lower - 1 == len(inside) - 1


def plain_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
    return levels


def plain_path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    path = []
    for row in levels[:-1]:
        first = i - i % 3
        path.append(("".join(row[first:i]), "".join(row[i + 1 : first + 3])))
        i //= 3
    return path


def plain_leaf(values) -> str:
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(shown, values)))


def manifest_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    names = [None, "", "é", "z", "hot"]
    rows = [(rng.randrange(10 * n), rng.choice(names) if rng.random() < 0.5 else "hot", rng.choice([None, "ü", "a:b", ""])) for _ in range(n)]
    return [*rows, (None, "z", "no key"), (None, "z", "no key"), *rows[:3]]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_every_proof_equals_a_plain_tree(spark, height):
    rows = manifest_rows(150, 3)
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    for name in ("tree", "pos", "block", "slot", "shard", "path", "at", "part", "row", "group", "key"):
        frame = frame.withColumn(name, F.lit("clash"))
    leaves = frame.withColumn("leaf", merkle.leaf(*map(F.col, ("doc_id", "source", "text"))))
    made = merkle.build_manifest(leaves, "source", "doc_id", "leaf", carry=["text", "tree"], height=height)
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        placed = sorted((r[0] is not None, r[0] or 0, plain_leaf(r), r) for r in groups[source])
        trees.append(([p[3] for p in placed], plain_tree([p[2] for p in placed])))
    top = plain_tree([levels[-1][0] for _, levels in trees])
    expected = Counter()
    for t, (placed, levels) in enumerate(trees):
        for i, row in enumerate(placed):
            path = plain_path(levels, i) + plain_path(top, t)
            expected[row, levels[0][i], levels[-1][0], top[-1][0], tuple(path)] += 1
    proofs = made.proofs().withColumn("folded", merkle.fold(F.col("digest"), F.col("path"))).collect()
    got = Counter(((r["row"]["key"], r["row"]["group"], r["row"]["text"]), r["digest"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in proofs)
    assert got == expected
    assert all(r["folded"] == r["root"] == made.root and r["row"]["tree"] == "clash" for r in proofs)


def test_manifest_of_one_row_and_of_none(spark):
    frame = spark.createDataFrame([(1, None, None)], "doc_id bigint, source string, text string")
    leaves = frame.withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text")))
    made = merkle.build_manifest(leaves, "source", "doc_id", "leaf")
    (row,) = made.proofs().collect()
    assert made.root == row["subroot"] == row["digest"] == sha("1:1-") and row["path"] == []
    none = merkle.build_manifest(leaves.where("false"), "source", "doc_id", "leaf")
    assert none.root is None and none.proofs().collect() == []


def test_a_saved_manifest_gives_the_same_proofs_and_finds_changes(spark, tmp_path):
    frame = spark.createDataFrame(manifest_rows(60, 5), "doc_id bigint, source string, text string").where("doc_id IS NOT NULL")
    frame = frame.dropDuplicates(["doc_id"]).withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text")))
    made = merkle.build_manifest(frame, "source", "doc_id", "leaf", height=2)
    merkle.save(made, str(tmp_path / "manifest"))
    stored = merkle.load(spark, str(tmp_path / "manifest"), height=2)
    assert stored.root == made.root
    plain = lambda m: sorted((r["digest"], str(r["path"])) for r in m.proofs().collect())
    assert plain(stored) == plain(made)
    changed = F.when(F.col("row.key") % 2 == 0, F.sha2("digest", 256)).otherwise(F.col("digest"))
    folded = stored.proofs().withColumn("same", merkle.fold(changed, F.col("path")) == F.col("root"))
    assert all(r["same"] == (r["row"]["key"] % 2 == 1) for r in folded.collect())


# Alignment


def plain_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = _byte_alphabet()
    a_bytes = {i: bytes(alphabet.get(c, 0) for c in p) for p, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    found = []
    for _, text in rows:
        groups = []
        if text:
            a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ends: list[dict] = [{}, {}]
            joined = [b"", b""]
            for side, ids in enumerate((a_ids, b_ids)):  # bytes of each token, and the offsets where they end
                for i in ids:
                    piece = b.id_to_piece(i) if side else ""
                    raw = a_bytes[i] if side == 0 else bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
                    joined[side] += raw
                    ends[side][len(joined[side])] = i
            if joined[0] == joined[1] == (" " + text).encode():
                held: list[list] = [[], []]
                for at in range(1, len(joined[0]) + 1):
                    for side in (0, 1):
                        if at in ends[side]:
                            held[side].append(ends[side][at])
                    if at in ends[0] and at in ends[1]:
                        groups.append(held)
                        held = [[], []]
        found.append(groups)
    counts = Counter((g[0][-1], g[1][-1]) for groups in found for g in groups)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = Counter()
    for (d, _), groups in zip(rows, found):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[
            d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), shown,
        ] += 1
    return out


ODD = [
    " lead", "trail ", "two  gaps", "a \n b", "tab\t x", "nl\n\n next", "<|endoftext|> and <s> </s> <0x0A> <unk>", "mark ▁ here", "▁",
    "日本語 のテキスト", "😀 emoji😀s", "no\xa0break \xa0space", "don't we'll 's", "x" * 3000, "é" * 400, " ", "\n", "12 345 6789", "ＡＢ ﬁ", "\x1c a\x85 b",
]


@pytest.mark.parametrize("run_chars,hot", [(4 << 20, 10_000), (700, 5)])
def test_alignment_equals_a_plain_version(spark, run_chars, hot):
    rows = [*ROWS, *((2000 + i, t) for i, t in enumerate(ODD)), *((3000 + i, ODD[5]) for i in range(40)), (None, "no id"), (None, None), (7, ROWS[3][1])]
    got = alignment.align_documents(common.documents(spark, rows), A, B, keep_groups=True, run_chars=run_chars, hot_share=hot).collect()
    found = Counter(tuple(r[c] for c in ("doc_id", *alignment.MEASURES, "groups")) for r in got)
    assert found == plain_alignment(rows)
    assert all(r["groups_sha256"] == (sha(r["groups"]) if r["n_a"] else "") for r in got)


def test_alignment_of_nothing(spark):
    assert alignment.align_documents(common.documents(spark, []), A, B).collect() == []
    (row,) = alignment.align_documents(common.documents(spark, [(1, None)]), A, B).collect()
    assert row["n_a"] == row["count_sum"] == 0 and row["groups_sha256"] == ""


def test_a_text_of_some_megabytes_and_a_bounded_memory(spark):
    rng = random.Random(2)
    text = common.prose(rng, 200_000)
    aligner = alignment.Aligner(A, B, most_bytes=1_000_000)
    small = [common.prose(rng, 50) for _ in range(30)]
    first = [b";".join(aligner.groups[p] for p in at) for at in aligner.align(small)]
    assert len(aligner.align([text])[0]) > 0 and aligner.held > aligner.most_bytes
    again = [b";".join(aligner.groups[p] for p in at) for at in aligner.align(small)]
    assert first == again and aligner.held < aligner.most_bytes


# Lines


def plain_lines(rows, least_chars=40, least_documents=5):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    place = lambda d: float("-inf") if d is None else d
    held = defaultdict(list)
    for d, text in rows:
        for k in {key(s) for s in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(place(d))
    out = Counter()
    for d, text in rows:
        split = (text or "").split("\n")
        kept = [s for s in split if len(held.get(key(s), ())) < least_documents or max(held[key(s)]) == place(d)]
        out[d, len(split), len(split) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows(seed=4):
    rng = random.Random(seed)
    pool = [common.prose(rng, 9).replace("\n", " ") for _ in range(30)] + ["Ä" * 39, "Ä" * 40, "short"]
    rows = []
    for i in range(120):
        some = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        some = [rng.choice(["", " ", "\t", "\x0b"]) + (s.upper() if rng.random() < 0.2 and s.isascii() else s) + rng.choice(["", "\r", "  "]) for s in some]
        rows.append((rng.randrange(150) if rng.random() < 0.9 else None, "\n".join(some)))
    return [*rows, (5, None), (6, ""), (7, "\n\n"), (8, "\n".join(pool * 300)), *rows[:5]]


@pytest.mark.parametrize("sizes", [(64 << 20, (1 << 20, 16 << 20)), (500, (700, 700))])
def test_lines_are_cut(spark, sizes):
    rows = line_rows()
    got = lines.drop_frequent_lines(common.documents(spark, rows), shard_bytes=sizes[0], chunk_bytes=sizes[1]).collect()
    assert Counter(tuple(r) for r in got) == plain_lines(rows)
    assert sum(r["n_dropped"] for r in got) > 300


def test_lines_of_nothing(spark):
    assert lines.drop_frequent_lines(common.documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        lines.drop_frequent_lines(common.documents(spark, []), least_documents=256)


def some_keys(n, seed):
    rng = np.random.default_rng(seed)
    keys = np.empty(n, lines.KEY)
    keys["high"], keys["low"] = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    keys["high"][: n // 10] = 7  # equal halves
    return keys


@pytest.mark.parametrize("n", [0, 1, 10, 20_000])
def test_the_hash_is_perfect_and_minimal(n):
    keys = some_keys(n, 1)
    made = lines.PerfectHash.build(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(n))
    if n > 1000:
        assert 8 * len(made.bits) < 5 * n


def test_unknown_keys_are_refused_and_equal_halves_are_told_apart(spark):
    rows = line_rows()
    index = lines.line_index(common.documents(spark, rows, clash=False), shards=1).collect()
    shard = lines.Shard(index[0].asDict())
    counts, holders = shard.probe(some_keys(5000, 9))
    assert not counts.any() and (holders == lines.NO_ID).all()
    keys = some_keys(50, 3)
    ordered = lines._distinct(np.concatenate([keys, keys]))
    assert (ordered[lines._find(keys, ordered)] == keys).all() and (lines._find(some_keys(9, 8)[1:], ordered) == -1).all()


def test_texts_are_shuffled_once_for_lines(spark, sf_dir):
    frame = lines.drop_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") + plan.count("ReusedExchange") >= 2
