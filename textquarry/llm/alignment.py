"""Alignment of the tokens of two tokenizers over a corpus.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with byte fallback)
the text, before which it puts a space itself, so both cover the same bytes. Offsets at which
tokens of both end cut the tokens into groups; the last tokens of a group are linked.

Each distinct text is worked on once: texts are shuffled whole with the number of their copies,
combined before the shuffle, and tokenised and aligned by the task that gets them. Pairs of linked
ids are counted per run of texts, weighted by copies, and summed over the corpus; each run then
meets the totals of its own pairs. Measures of a text go back to its documents by its digest.

Neither tokenizer joins tokens across a single space between other characters (checked for B's
vocabulary), so texts are cut there and the alignment of a cut is remembered; texts with other
white space, and cuts on which the tokenizers disagree, are aligned whole.

Defined results: texts that are null, empty, or not given back byte for byte by both tokenizers
have no tokens: all counts are zero and the groups are empty; rows that repeat a doc_id are
documents of their own; a null doc_id is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textquarry.llm.tokens import PATTERN, PLAIN
from textquarry.llm.tokens import _byte_alphabet as byte_alphabet
from textquarry.session import cut_lineage

SPACE_MARK = "▁"
DIGITS = 7  # of a token id, at most
BAD = -1


def _digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, from the left, and how many they are."""
    text = np.array([str(i).encode() for i in range(n)], f"S{DIGITS}")
    return text.view(np.uint8).reshape(n, DIGITS), np.char.str_len(text).astype(np.int64)


class Aligner:
    """Aligned tokens of many texts. One per Python worker; what it remembers is bounded in bytes."""

    def __init__(self, a_path: str, b_path: str, most_bytes: int = 128 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = json.load(open(a_path, encoding="utf-8"))["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            if all(c in alphabet for c in piece):
                self.a_bytes[i] = bytes(alphabet[c] for c in piece)
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for piece, i in vocabulary.items() if piece not in special}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.breaks = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.digits, self.digit_counts = _digit_table(max(len(self.a_bytes), len(self.b_bytes)))
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.cuts: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.tokens: list[tuple[int, int]] = []  # of A and B; BAD where the bytes differ
        self.links = np.zeros(1 << 16, np.int64)  # linked pairs, one remembered text after another
        self.bounds = [0]
        self.held = 0

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A, by tiktoken over the same vocabulary for short Latin texts, and of B."""
        a: list = [self.plain.encode_ordinary(" " + t) if len(t) < 200 and PLAIN.fullmatch(t) else None for t in texts]
        other = [i for i, ids in enumerate(a) if ids is None]
        for i, found in zip(other, self.a.encode_batch([" " + texts[i] for i in other], add_special_tokens=False)):
            a[i] = found.ids
        return a, self.b.encode(texts, num_threads=1)

    def _remember(self, texts: list[str], most: int = 1 << 20) -> int:
        """Align some texts whole; their places begin at the result."""
        first, some, size = len(self.groups), [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= most:
                self._align_whole(some)
                some, size = [], 0
        if some:
            self._align_whole(some)
        return first

    def _align_whole(self, texts: list[str]) -> None:
        a_ids, b_ids = self._encode(texts)
        sides = []
        wholes = [(" " + t).encode() for t in texts]
        sizes = np.array([len(w) for w in wholes], np.int64)
        expected = np.frombuffer(b"".join(wholes), np.uint8)
        good = np.ones(len(texts), bool)
        for ids, known in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)):
            flat = [i for some in ids for i in some]
            of = np.repeat(np.arange(len(ids)), [len(some) for some in ids])
            pieces = [known[i] for i in flat]
            lengths = np.array([len(p) for p in pieces], np.int64)
            joined = np.frombuffer(b"".join(pieces), np.uint8)
            sides.append((np.array(flat, np.int64), of, lengths))
            good &= np.bincount(of, lengths, len(texts)).astype(np.int64) == sizes
            kept, wanted = joined[np.repeat(good[of], lengths)], expected[np.repeat(good, sizes)]
            if not np.array_equal(kept, wanted):
                good[np.repeat(np.flatnonzero(good), sizes[good])[kept != wanted]] = False
        (a, a_of, a_lengths), (b, b_of, b_lengths) = ((x[good[of]], of[good[of]], n[good[of]]) for x, of, n in sides)
        text, text_bounds, links, link_bounds = self._grouped(a, a_lengths, b, b_lengths, np.cumsum(np.where(good, sizes, 0)))
        n_a, n_b = np.bincount(a_of, minlength=len(texts)).tolist(), np.bincount(b_of, minlength=len(texts)).tolist()
        token_bounds = np.concatenate([[0], np.cumsum(np.array(n_a) + np.array(n_b))])
        cuts = text_bounds[token_bounds].tolist()
        self.groups += [text[x : y - 1] if y > x else b"" for x, y in zip(cuts[:-1], cuts[1:])]
        self.tokens += [(x, y) if fits else (BAD, BAD) for x, y, fits in zip(n_a, n_b, good.tolist())]
        used = self.bounds[-1]
        if used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(max(len(self.links), len(links)), np.int64)])
        self.links[used : used + len(links)] = links
        self.bounds += (used + link_bounds).tolist()
        self.held += len(text) + 8 * len(links) + 350 * len(texts) + int(sizes.sum())

    def _grouped(self, a: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_lengths: np.ndarray, ends: np.ndarray):
        """All groups as text with the bounds of its tokens, and the linked pairs with their bounds by text."""
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        ids = np.concatenate([a, b])[order]
        last = np.concatenate([common[a_group] == a_ends, common[b_group] == b_ends])[order] if len(ids) else np.zeros(0, bool)
        after = np.where(last, np.where(order < len(a), ord("|"), ord(";")), ord(",")).astype(np.uint8)
        shown = np.zeros((len(ids), DIGITS + 1), np.uint8)
        shown[:, :DIGITS] = self.digits[ids]
        counts = self.digit_counts[ids]
        shown[np.arange(len(ids)), counts] = after
        text = shown[np.arange(DIGITS + 1) <= counts[:, None]].tobytes()
        links = (a[np.searchsorted(a_ends, common)] << 32) | b[np.searchsorted(b_ends, common)]
        return text, np.concatenate([[0], np.cumsum(counts + 1)]), links, np.searchsorted(common, ends, "right")

    def _cut(self, text: str) -> list[str] | None:
        """The parts of a text between single spaces, if they can be aligned apart."""
        if not self.breaks or SPACE_MARK in text:
            return None
        parts = text.split(" ")
        if any(not p or p[0].isspace() for p in parts):
            return None
        return parts

    def align(self, texts: list[str]) -> list[list[int]]:
        """The places of each text's parts; none for a text without tokens."""
        if self.held > self.most_bytes:
            self.forget()
        parts = [self._cut(t) for t in texts]
        fresh = list(dict.fromkeys(p for found in parts if found for p in found if p not in self.cuts))
        first = self._remember(fresh)
        self.cuts.update(zip(fresh, range(first, first + len(fresh))))
        places: list[list[int]] = [list(map(self.cuts.__getitem__, found)) if found else [] for found in parts]
        whole = [i for i, at in enumerate(places) if not at or any(self.tokens[p][0] == BAD for p in at)]
        first = self._remember([texts[i] for i in whole])
        for k, i in enumerate(whole):
            places[i] = [first + k] if self.tokens[first + k][0] != BAD else []
        return places

    def linked(self, places: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of texts, one after another, and their bounds."""
        flat = np.array([p for at in places for p in at], np.int64)
        bounds = np.array(self.bounds, np.int64)
        starts, counts = bounds[flat], bounds[flat + 1] - bounds[flat]
        ends = np.cumsum(counts)
        pairs = self.links[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]
        of_texts = np.cumsum([0, *(len(at) for at in places)])
        return pairs, np.concatenate([[0], ends])[of_texts]


ALIGNED = (
    "key binary, run bigint, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, groups string, "
    "links binary, pairs array<bigint>, weights array<bigint>"
)
_KINDS = (
    ("key", pa.binary()), ("run", pa.int64()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
)

_aligners: dict[tuple[str, str], Aligner] = {}


def _run_rows(aligner: Aligner, keys: list[bytes], copies: list[int], texts: list[str], keep_groups: bool) -> pa.RecordBatch:
    """A row for each text of a run, and one for the run's distinct pairs with their weights."""
    run = int.from_bytes(hashlib.sha256(b"".join(keys)).digest()[:8], "little", signed=True)
    found, rows = aligner.align(texts), []
    links, edges = aligner.linked(found)
    pairs, where = np.unique(links, return_inverse=True)
    weights = np.bincount(where, np.repeat(np.array(copies, np.float64), np.diff(edges)), len(pairs))
    where = where.astype("<u4")
    for i, at in enumerate(found):
        n_a, n_b = map(sum, zip(*(aligner.tokens[p] for p in at))) if at else (0, 0)
        groups = b";".join([aligner.groups[p] for p in at])
        digest = hashlib.sha256(groups).hexdigest() if at else ""
        shown = groups.decode() if keep_groups else None
        blob = where[edges[i] : edges[i + 1]].tobytes()
        rows.append((keys[i], run, copies[i], n_a, n_b, int(edges[i + 1] - edges[i]), digest, shown, blob, None, None))
    rows.append((None, run, None, None, None, None, None, None, None, pairs, weights.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _KINDS)], names=[n for n, _ in _KINDS])


def _align(a_path: str, b_path: str, keep_groups: bool, run_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (a_path, b_path)
        if paths not in _aligners:
            _aligners[paths] = Aligner(*paths)
        keys, copies, texts, size = [], [], [], 0
        for batch in batches:
            for key, count, text in zip(batch["key"], batch["copies"], batch["text"]):
                keys.append(key.as_py())
                copies.append(count.as_py())
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= run_chars:
                    yield _run_rows(_aligners[paths], keys, copies, texts, keep_groups)
                    keys, copies, texts, size = [], [], [], 0
        if texts:
            yield _run_rows(_aligners[paths], keys, copies, texts, keep_groups)

    return run


def _measured(texts: pa.Table, totals: pa.Table) -> pa.Table:
    """The sums over each text's links of the totals of their pairs."""
    at = totals["at"].to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = totals["total"].to_numpy(), totals["best"].to_numpy()
    sums = []
    for blob in texts["links"].to_pylist():
        links = np.frombuffer(blob, "<u4")
        sums.append((len(links), int(best[links].sum()), int(total[links].sum())))
    columns = [texts["key"].combine_chunks(), *(pa.array(c, pa.int64()) for c in (zip(*sums) if sums else [()] * 3))]
    return pa.Table.from_arrays(columns, names=["key", "n_links", "n_best", "count_sum"])


def _digest(text: str):
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def align_texts(documents: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, run_chars: int = 4 << 20) -> DataFrame:
    """The aligned distinct texts, written: a row for each (by `key`), and one for the pairs of each run."""
    filled = documents.where("text IS NOT NULL AND text <> ''")
    distinct = filled.groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", _digest("text"))
    return cut_lineage(distinct.select("key", "copies", "text").mapInArrow(_align(a_path, b_path, keep_groups, run_chars), ALIGNED))


def pair_totals(aligned: DataFrame) -> DataFrame:
    """a, b, total (links that hold the pair linked, in all documents), best (the most of its B id)."""
    pairs = aligned.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "weights")))
    totals = cut_lineage(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("weights").alias("total")))
    totals = totals.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "total")
    # A row for each id of B's vocabulary at most.
    most = totals.groupBy(F.col("b").alias("of")).agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), F.col("b") == F.col("of")).select("pair", "a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_documents(
    documents: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, run_chars: int = 4 << 20, hot_share: int = 10_000
) -> DataFrame:
    """Every document (doc_id, text) with its measures, the digest of its groups and, if asked for, the groups.

    A text that more than one in `hot_share` documents holds goes to all tasks; there are fewer
    than `hot_share` such texts. The others meet their documents in a shuffle.
    """
    documents = documents.select("doc_id", "text")
    aligned = align_texts(documents, a_path, b_path, keep_groups, run_chars)
    totals = pair_totals(aligned).select("pair", "total", "best")
    asked = aligned.where("pairs IS NOT NULL").select(F.col("run").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(totals, "pair").select("of", "at", "total", "best")
    texts = aligned.where("key IS NOT NULL")
    sums = (
        texts.select("run", "key", "links").groupBy("run").cogroup(answers.groupBy("of"))
        .applyInArrow(_measured, "key binary, n_links bigint, n_best bigint, count_sum bigint")
    )
    groups = ["groups_sha256", *(["groups"] if keep_groups else [])]
    measures = cut_lineage(texts.join(sums, "key").select("key", "copies", *MEASURES, *groups))

    rows = cut_lineage(documents.select("doc_id", F.when(F.col("text") != "", _digest("text")).alias("key")))
    hot = measures.where(F.col("copies") * hot_share > rows.count()).drop("copies")
    columns = ["doc_id", *MEASURES, *groups]
    empty = [F.lit(0).cast("bigint").alias(c) for c in MEASURES] + [F.lit("").alias(c) for c in groups]
    without = rows.where("key IS NULL").select("doc_id", *empty)
    known = rows.where("key IS NOT NULL")
    common = known.join(F.broadcast(hot), "key").select(*columns)
    others = known.join(F.broadcast(hot.select("key")), "key", "left_anti").join(measures.drop("copies"), "key").select(*columns)
    return without.unionByName(common).unionByName(others)
