"""Small document tables and plain versions of the operators, written without the engine."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COMMON = ["the", "of", "and", "un", "für", "größer", "x", "Is", "a|b", "die"]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(COMMON) if rng.random() < 0.3 else "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 12))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words).strip()


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = []
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 45)
    for i, text in enumerate(base):
        rows.append((i, text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = text.split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(["edit", "", "Ünï"])
            rows.append((100 + len(rows), " ".join(words)))
        if i % 4 == 0:
            rows.append((300 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 10)))
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "two words"), (906, passage), (907, passage + " " + passage)]
    rows += [(908, "ab " * 60), (909, "Ab " * 60), (910, "x" * 5000), (911, prose(rng, 4000)), (912, "five words are right here"), (0, base[0])]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    if clash:  # names that operators use themselves
        for name in ("chunk", "block", "node", "component", "group", "key", "start", "region", "label", "n_words", "kept", "shard"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words_of(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = words_of(text, lower=True)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def classes(rows) -> dict[int, int]:
    """The least id that each document reaches by links of similarity 0.75 or more."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in sets}


def without_repeats(rows, window: int = 20) -> dict:
    """(doc_id, text) -> (words, removed, kept text); a null id counts as the largest."""
    place = lambda d: float("inf") if d is None else d
    first: dict = {}
    for d, t in rows:
        words = words_of(t)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, (float("inf"), float("inf"))), (place(d), s))
    out = {}
    for d, t in rows:
        words = words_of(t)
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (place(d), s):
                gone |= set(range(s, s + window))
        out[d, t] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def grouped(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
