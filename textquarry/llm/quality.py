"""Quality rules and importance resampling by hashed n-gram models of target and raw text.

`llr` is the log-likelihood ratio of a text under the multinomial of the trusted target and that
of the raw corpus, both without the text's own counts, so that trusted and other documents are
judged alike. The rules divide it by the number of n-grams and cut at one threshold; resampling
takes the sum as the log of the importance weight and keeps the top k after Gumbel noise.

Defined results: null or empty text has no words and fails the base rules, with ratio 0; a null
doc_id is not trusted and is noised as an empty string; equal keys in the top k go to the smaller
doc_id; repeated rows are judged each; without trusted rows the ratio is 0 and the threshold keeps
all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm import hashed
from textquarry.llm.words import SEPARATOR, mixed, parts, sequences
from textquarry.session import cut_lineage

#: Fixed value: the symbols that the base rules count.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
TRUST = 0.5  # added to each bucket's count


def with_trust(documents: DataFrame, trusted: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Adds `group`: 1 for documents whose doc_id is in `trusted`, else 0."""
    ids = cut_lineage(trusted.select(F.col("doc_id").alias("trusted_id")).filter("trusted_id IS NOT NULL").distinct())
    few = ids.count() <= most  # a broadcast of at most 16 MB, else a shuffled join
    joined = documents.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("trusted_id"), "left")
    return joined.select("doc_id", "text", F.col("trusted_id").isNotNull().cast("int").alias("group"))


def measures(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of runs of rows."""
    for _, _, words in parts(column):
        body, bounds, at = words.data[:-8], words.bounds, words.offsets
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
        lines = []
        raw = body.tobytes()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            some = [line for line in raw[a:b].split(b"\n") if line.strip()]
            lines.append(len(some) - len(set(some)))
        document = words.documents()
        triples = sequences(words.hashes(), 3)
        place = np.flatnonzero(np.repeat(at[1:], words.counts) - np.arange(at[-1]) >= 3)
        _, inverse, count = np.unique(mixed(triples[place] ^ mixed(document[place].astype(np.uint64))), return_inverse=True, return_counts=True)
        covered = np.zeros(int(at[-1]), bool)
        again = place[count[inverse] > 1]
        for step in range(3):
            covered[again + step] = True
        repeats = np.diff(np.concatenate([[0], np.cumsum(covered)])[at])
        yield words.counts, sums(((body & 0xC0) != 0x80) & ~SEPARATOR[body]), sums(SYMBOLS[body]), np.array(lines, np.int64), repeats


MEASURED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MEASURED.split(", ")]
    for batch in batches:
        row = 0
        for columns in measures(batch.column("text")):
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, n), *(pa.array(c.astype(np.int64)) for c in columns)], names=names
            )
            row += n


def ratios(column: pa.Array, group: np.ndarray, counts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sum of log ratios, number of n-grams) of runs of rows; group 1 rows are in the target counts."""
    bits = (counts.shape[1] - 1).bit_length()
    target, raw = counts[1], counts.sum(axis=0)
    all_target, all_raw = int(target.sum()), int(raw.sum())
    for first, until, values, offsets in hashed.grams(column, n, bits):
        rows, sizes = until - first, np.diff(offsets)
        document = np.repeat(np.arange(rows), sizes)
        key, own = np.unique(document << bits | values, return_counts=True)
        d, bucket = key >> bits, key & ((1 << bits) - 1)
        inside = group[first:until] == 1
        t = target[bucket] - own * inside[d] + TRUST
        r = raw[bucket] - own + TRUST
        whole_t = all_target - sizes * inside + TRUST * (1 << bits)
        whole_r = all_raw - sizes + TRUST * (1 << bits)
        sums = np.bincount(d, weights=own * (np.log(t) - np.log(r)), minlength=rows)
        yield (sums - sizes * (np.log(whole_t) - np.log(whole_r))) if all_target else np.zeros(rows), sizes


def _rate(shared, n: int, base: bool):
    names = [f.split()[0] for f in (RATED if base else WEIGHED).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            group = batch.column("group").to_numpy(zero_copy_only=False)
            row = 0
            found = ratios(batch.column("text"), group, counts, n)
            rules = measures(batch.column("text")) if base else None
            for total, sizes in found:
                k = len(total)
                columns = [batch.column("doc_id").slice(row, k), batch.column("group").slice(row, k)]
                columns += [pa.array(total), pa.array(sizes.astype(np.int64))]
                if base:
                    columns += [pa.array(c.astype(np.int64)) for c in next(rules)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += k

    return run


WEIGHED = "doc_id bigint, group int, ratio double, n_grams bigint"
RATED = WEIGHED + MEASURED.removeprefix("doc_id bigint")


def rated(documents: DataFrame, trusted: DataFrame, n: int, bits: int, base: bool) -> DataFrame:
    """Every document's log-likelihood ratio, with the base measures if asked."""
    rows = with_trust(documents.select("doc_id", "text"), trusted)
    counts = hashed.fit(rows, 2, n, bits)
    shared = documents.sparkSession.sparkContext.broadcast(counts)  # 16 * 2**bits bytes
    return cut_lineage(rows.mapInArrow(_rate(shared, n, base), RATED if base else WEIGHED))


def threshold(scores: DataFrame, steps: int = 2000, low: float = -4.0, high: float = 4.0) -> float:
    """The score that best tells trusted from untrusted rows (score, good), by balanced accuracy.

    Scores are counted in `steps` equal bins, so the driver gets that many rows at most. Ties go
    to the lowest threshold; without both kinds it keeps all.
    """
    place = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((F.col("score") - low) / (high - low) * steps).cast("int")))
    bins = scores.groupBy(place.alias("bin")).agg(F.sum(F.col("good").cast("int")).alias("good"), F.count("*").alias("all")).collect()
    good, bad = np.zeros(steps + 2, np.int64), np.zeros(steps + 2, np.int64)
    for b in bins:
        good[b["bin"]], bad[b["bin"]] = b["good"], b["all"] - b["good"]
    if not good.sum() or not bad.sum():
        return float("-inf")
    kept = good[::-1].cumsum()[::-1] / good.sum()  # at or above each bin
    gone = 1 - bad[::-1].cumsum()[::-1] / bad.sum()
    return low + float(np.argmax(kept + gone)) * (high - low) / steps


def quality_rules(documents: DataFrame, labels: DataFrame, n: int = 4, bits: int = 18) -> DataFrame:
    """Base rules and the thresholded, length-normalised ratio of every document.

    `labels`: doc_id, quality (1: trusted). Trusted documents are the target; all labels together
    set the threshold.
    """
    scored = rated(documents, labels.filter("quality = 1"), n, bits, base=True).withColumn(
        "score", F.when(F.col("n_grams") > 0, F.col("ratio") / F.col("n_grams")).otherwise(0.0)
    )
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    judged = scored.join(marked, F.col("doc_id") == F.col("id")).select("score", (F.col("quality") == 1).alias("good"))
    cut = threshold(judged)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("score") >= F.lit(cut))).alias("kept"), "score",
    )


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and seed only."""
    uniform = (F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int, steps: int = 4096) -> float:
    """The kth largest of the column `key`, by narrowing histograms of `steps` bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0  # keys over `high`
    while low < high:
        width = (high - low) / steps
        if width <= 0 or low + width == low:
            break
        inside = keys.filter((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        place = F.least(F.lit(steps - 1), F.floor((F.col("key") - F.lit(low)) / F.lit(width)).cast("int"))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high = b["least"], b["most"]
                break
            above += b["n"]
    return low


def importance_resample(
    documents: DataFrame, labels: DataFrame, share: float | None = None, n: int = 4, bits: int = 18, seed: int = 23
) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept): the Gumbel top k of all documents.

    k is `share` of all documents; by default the share of trusted ones among the labels.
    """
    scored = rated(documents, labels.filter("quality = 1"), n, bits, base=False)
    keyed = scored.withColumn("key", F.col("ratio") + gumbel(F.col("doc_id"), seed))
    if share is None:
        good, known = labels.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("quality")).first()
        share = (good or 0) / known if known else 1.0
    total = keyed.count()
    k = min(total, round(total * share))
    kept = F.lit(False)
    if k:
        cut = kth_largest(keyed, k)
        over = keyed.filter(F.col("key") > F.lit(cut)).count()
        # Of the rows that tie with the kth key, which are few, the smaller ids are kept.
        tied = cut_lineage(keyed.filter(F.col("key") == F.lit(cut)).select("doc_id").orderBy(F.col("doc_id").asc_nulls_last()).limit(k - over))
        last = tied.agg(F.max("doc_id"), F.count("*"), F.count("doc_id")).first()
        kept = (F.col("key") > F.lit(cut)) | ((F.col("key") == F.lit(cut)) & F.coalesce(F.col("doc_id") <= F.lit(last[0]), F.lit(last[1] > last[2])))
    return keyed.select("doc_id", "n_grams", F.col("ratio").alias("log_weight"), F.col("key").alias("gumbel_key"), kept.alias("kept"))
