"""Language-model scores from a weighted backoff automaton over word n-grams.

States are the contexts seen in training. A state has an arc for every n-gram seen from it, with
the interpolated weight log10((c(context, w) + m * p(w | shorter context)) / (c(context) + m)),
and a failure arc to the shorter context with the weight log10(m / (c(context) + m)). The root
holds the add-0.1 unigram model. A text is read once from left to right: a token without an arc
takes failure arcs until it finds one. The counts live in blocks of the key space; a chunk of
documents is answered the counts of its own n-grams, which is the part of the automaton it walks.

Defined results: null or empty text is a single end token; a null doc_id counts as empty text for
the split; repeated rows count and are scored as often as they occur; with no training rows N and
V are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm import exchange
from textquarry.llm.words import mixed, parts, sequences

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
ADDED = 0.1


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d in doc_ids], bool)


class Tokens:
    """The padded token sequences of a table of documents and the keys of their n-grams."""

    def __init__(self, docs: pa.Table, order: int):
        self.order = order
        self.ids = docs["doc_id"].to_pylist()
        hashes, counts = [], []
        for _, _, words in parts(docs["text"], lower=True):
            hashes.append(words.hashes())
            counts.append(words.counts)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        pad = order - 1
        self.lengths = counts + 1
        ends = np.cumsum(self.lengths + pad)
        self.begins = ends - self.lengths  # of the tokens, after the padding
        padded = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
        is_token = np.zeros(len(padded), bool)
        self.tokens = np.repeat(self.begins, self.lengths) + _within(self.lengths)
        is_token[self.tokens] = True
        padded[ends - 1] = END
        is_word = is_token.copy()
        is_word[ends - 1] = False
        padded[is_word] = words
        self.ends = ends - 1
        # An even key is a longer n-gram, an odd one a single token.
        self.grams = {1: mixed(padded) | np.uint64(1)}
        for n in range(2, order + 1):
            keys = np.zeros(len(padded), np.uint64)
            keys[n - 1 :] = sequences(padded, n) & ~np.uint64(1)
            self.grams[n] = keys
        self.keys, self.place = np.unique(np.concatenate([self.grams[n][self.tokens] for n in self.grams]), return_inverse=True)

    def training_counts(self) -> np.ndarray:
        trained = np.repeat(~held_out(self.ids), self.lengths)
        return np.bincount(self.place, weights=np.tile(trained, self.order), minlength=len(self.keys)).astype(np.uint32)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


ASKED = "chunk int, block int, keys binary, counts binary"
ANSWERED = "chunk int, block int, width int, counts binary, tokens bigint, distinct bigint"


def _ask(order: int, blocks: int):
    def run(docs: pa.Table) -> pa.Table:
        tokens = Tokens(docs, order)
        counts, edges = tokens.training_counts(), exchange.block_edges(tokens.keys, blocks)
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.table(
            {
                "chunk": pa.array([docs["chunk"][0].as_py()] * blocks, pa.int32()),
                "block": pa.array(range(blocks), pa.int32()),
                "keys": exchange.planes([tokens.keys[a:b] for a, b in spans]),
                "counts": exchange.planes([counts[a:b] for a, b in spans]),
            }
        )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """The total count of each key, to every chunk that asked, and this block's share of N and V."""
    rows = [exchange.from_planes(k, np.uint64) for k in asked["keys"].to_pylist()]
    sizes, keys = np.array([len(r) for r in rows]), np.concatenate(rows)
    counts = np.concatenate([exchange.from_planes(c, np.uint32) for c in asked["counts"].to_pylist()])
    distinct, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
    single = (distinct & np.uint64(1)).astype(bool)
    narrow = np.dtype(f"u{next(w for w in (1, 2, 4, 8) if not len(totals) or int(totals.max()) < 1 << (8 * w))}")
    replies = np.split(totals.astype(narrow)[place], np.cumsum(sizes)[:-1])
    n = asked.num_rows
    return pa.table(
        {
            "chunk": asked["chunk"],
            "block": asked["block"],
            "width": pa.array([narrow.itemsize] * n, pa.int32()),
            "counts": exchange.planes(replies),
            "tokens": pa.array([int(totals[single].sum())] * n, pa.int64()),
            "distinct": pa.array([int((totals[single] > 0).sum())] * n, pa.int64()),
        }
    )


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def walk(tokens: Tokens, counts: np.ndarray, total: int, distinct: int, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: the log weight of its walk, that of the unigram model, and its unigram count."""
    size = len(tokens.grams[1])
    seen, at = {}, 0
    for n in tokens.grams:
        seen[n] = np.zeros(size)
        seen[n][tokens.tokens] = counts[tokens.place[at : at + len(tokens.tokens)]]
        at += len(tokens.tokens)
    here = tokens.tokens
    root = np.log10((seen[1][here] + ADDED) / (total + ADDED * (distinct + 1)))
    arcs, left = {1: root}, {}
    starts = seen[1][tokens.ends[0]] if len(tokens.ends) else 0.0  # every training text ends once and starts once
    for n in range(2, tokens.order + 1):
        context = seen[n - 1][here - 1]
        context[_within(tokens.lengths) == 0] = starts
        arcs[n] = np.log10((seen[n][here] + m * 10 ** arcs[n - 1]) / (context + m))
        left[n] = np.log10(m / (context + m))
    weight, open_ = np.zeros(len(here)), np.ones(len(here), bool)
    for n in range(tokens.order, 1, -1):  # a failure arc leads to the next shorter context
        found = open_ & (seen[n][here] > 0)
        weight[found] += arcs[n][found]
        open_ &= ~found
        weight[open_] += left[n][open_]
    weight[open_] += root[open_]
    return weight, root, seen[1][here]


def _score(order: int, m: float):
    names = [f.split()[0] for f in SCORED.split(", ")]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)], names=names)
        tokens = Tokens(docs, order)
        answers = answers.sort_by("block")
        replies = zip(answers["width"].to_pylist(), answers["counts"].to_pylist())
        counts = np.concatenate([exchange.from_planes(c, f"u{w}").astype(np.float64) for w, c in replies])
        total, distinct = sum(answers["tokens"].to_pylist()), sum(answers["distinct"].to_pylist())
        weight, root, known = walk(tokens, counts, total, distinct, m)
        firsts = np.cumsum(tokens.lengths) - tokens.lengths
        n = len(tokens.lengths)
        return pa.table(
            [
                pa.array(tokens.ids, pa.int64()),
                pa.array(held_out(tokens.ids)),
                pa.array(tokens.lengths.astype(np.int64)),
                pa.array(np.add.reduceat((known > 0).astype(np.int64), firsts)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(np.add.reduceat(root, firsts)),
                pa.array(np.add.reduceat(weight, firsts)),
            ],
            names=names,
        )

    return run


def score(documents: DataFrame, order: int = 2, m: float = 4.0, chunk_bytes: int = 4 << 20, block_bytes: int = 6 << 20) -> DataFrame:
    """Scores of every document (doc_id, text) by a model of the training documents among them.

    `m`: how many counts the shorter context weighs. A block serves the n-grams of about
    `block_bytes` of text. Chunks and blocks grow in number with the input, not in size.
    """
    size = exchange.text_size(documents)
    docs = exchange.dealt(documents.select("doc_id", "text"), chunk_bytes, size)
    blocks = max(16, -(-size // block_bytes))
    asked = docs.groupBy("chunk").applyInArrow(_ask(order, blocks), ASKED)
    answers = asked.groupBy("block").applyInArrow(_answer, ANSWERED)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, m), SCORED)
