"""Language identification by Bayesian fusion of evidence.

The posterior of a row's language multiplies: the likelihood of its text under hashed byte n-gram
models of each language (tempered, since n-grams overlap), the likelihood of the language it
declares, the likelihood of its address suffix, and a prior of its host. Host priors are smoothed
hierarchically: a host's counts lean on those of its domain, and these on all rows. Suffix and
host counts are grouped aggregates over all rows, by the language of text and declaration; a row's
own vote is taken out of its prior. `und` stands for text that no model explains better than
chance; such rows are rejected, and so are rows whose best posterior is under `sure`.

Defined results: null or blank text has no n-gram and is rejected; a null or unknown declaration,
address or host gives no evidence; equal posteriors go to the first language in the given order;
repeated rows count and are judged each; an empty table gives an empty result; of other columns only
the keys are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm import hashed
from textquarry.llm.words import give_back
from textquarry.session import cut_lineage

UNKNOWN = "und"


def index_of(value: Column, languages: tuple[str, ...]) -> Column:
    """The place of a language code such as `en` or `en-GB` among the languages, or null."""
    code = F.lower(F.substring_index(F.replace(F.trim(value), F.lit("_"), F.lit("-")), "-", 1))
    place = F.array_position(F.array(*map(F.lit, languages)), code)
    return F.when(place > 0, (place - 1).cast("int"))


def _padded(text: Column) -> Column:
    """The text between single spaces, so that one letter makes an n-gram; null if it is blank."""
    body = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    return F.when(body != "", F.concat(F.lit(" "), body, F.lit(" ")))


def train(examples: DataFrame, languages: tuple[str, ...], n: int = 3, bits: int = 16) -> np.ndarray:
    """Log-probabilities, languages x buckets, from all rows (text, lang) that name a language."""
    counts = hashed.fit(examples.select(_padded(F.col("text")).alias("text"), index_of(F.col("lang"), languages).alias("group")), len(languages), n, bits) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _likelihoods(shared, n: int, bits: int, temper: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chance = -bits * np.log(2)
        for batch in batches:
            logs, sizes = [], []
            for first, until, values, offsets in hashed.grams(batch.column("text"), n, bits):
                own = np.diff(offsets)
                # Relative to chance, so that the unknown language is at 0.
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(m[values] - chance)])[offsets]) for m in model]
                logs.append(np.stack(sums, axis=1) * temper)
                sizes.append(own)
            flat = np.concatenate(logs) if logs else np.zeros((0, len(model)))
            offsets = np.arange(len(flat) + 1, dtype=np.int32) * len(model)
            arrays = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())), pa.array(np.concatenate(sizes or [offsets[:0]]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "text_logs", "n_grams"])
        give_back()

    return run


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _votes(rows: DataFrame, key: str, count: int) -> DataFrame:
    """(key, votes array): how many rows of each first guess a key has, by one grouped aggregation."""
    sums = [F.sum((F.col("guess") == i).cast("double")).alias(f"v{i}") for i in range(count)]
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_key")).agg(*sums).select(
        f"{key}_key", F.array(*(f"v{i}" for i in range(count))).alias(f"{key}_votes")
    )


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def identify(
    rows: DataFrame, model: np.ndarray, languages: tuple[str, ...], *, keys: tuple[str, ...] = ("doc_id",), n: int = 3, temper: float = 0.25, declared_right: float = 0.9,
    lean: float = 5.0, sure: float = 0.5,
) -> DataFrame:
    """The rows' keys with n_grams, language, posterior and accepted.

    `rows`: keys, text, declared, host. `lean`: how many votes a level leans on
    the one above it.
    """
    L = len(languages)
    bits = (model.shape[1] - 1).bit_length()
    shared = rows.sparkSession.sparkContext.broadcast(model)  # set in size by languages and bits
    rows = rows.select(*keys, "declared", "host", _padded(F.col("text")).alias("text"))
    others = rows.drop("text").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others.fields), "text_logs array<double>", "n_grams bigint"])
    read = cut_lineage(rows.mapInArrow(_likelihoods(shared, n, bits, temper), schema))
    declared = index_of(F.col("declared"), languages)
    told = F.array(
        *(F.when(declared.isNull(), 0.0).when(declared == i, float(np.log(declared_right))).otherwise(float(np.log((1 - declared_right) / max(1, L - 1)))) for i in range(L)),
        F.when(declared.isNull(), 0.0).otherwise(float(np.log(1 / L))),
    )
    text_logs = F.concat("text_logs", F.array(F.lit(0.0)))
    first = F.zip_with(text_logs, told, lambda a, b: a + b)
    guess = (F.array_position(first, F.array_max(first)) - 1).cast("int")
    voted = (
        read.withColumn("first", first)
        .withColumn("guess", F.when(F.col("n_grams") > 0, guess))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    totals = voted.filter("guess IS NOT NULL").groupBy("guess").count().collect()  # a row per language
    base = np.ones(L + 1)
    for r in totals:
        base[r["guess"]] += r["count"]
    base_share = F.array(*(F.lit(float(b)) for b in base / base.sum()))
    fused = voted
    for key in ("suffix", "domain", "host"):
        votes = cut_lineage(_votes(voted, key, L + 1))
        fused = fused.join(votes, F.col(key) == F.col(f"{key}_key"), "left").drop(f"{key}_key")

    def others_votes(key: str) -> Column:
        none = F.array(*[F.lit(0.0)] * (L + 1))
        own = lambda v, i: F.greatest(v - (F.col("guess").eqNullSafe(i.cast("int"))).cast("double"), F.lit(0.0))
        return F.transform(F.coalesce(f"{key}_votes", none), own)

    def leaning(votes: Column, above: Column) -> Column:
        total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(votes, above, lambda v, p: (v + lean * p) / (total + lean))

    fused = fused.withColumn("domain_share", leaning(others_votes("domain"), base_share))
    fused = fused.withColumn("host_share", leaning(others_votes("host"), F.col("domain_share")))
    # P(suffix | language) up to a factor that all languages share: P(language | suffix) / P(language).
    fused = fused.withColumn("suffix_share", leaning(others_votes("suffix"), base_share))
    suffix_logs = F.zip_with("suffix_share", base_share, lambda a, b: F.log(a / b))
    logs = F.zip_with(F.zip_with("first", F.transform("host_share", lambda p: F.log(p)), lambda a, b: a + b), suffix_logs, lambda a, b: a + b)
    fused = fused.withColumn("posteriors", _softmax(logs))
    best = (F.array_position("posteriors", F.array_max("posteriors"))).cast("int")
    language = F.when(F.col("n_grams") > 0, F.element_at(F.array(*map(F.lit, (*languages, UNKNOWN))), best)).otherwise(UNKNOWN)
    return (
        fused.withColumn("language", language)
        .withColumn("posterior", F.array_max("posteriors"))
        .withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= sure))
        .select(*keys, "n_grams", "language", "posterior", "accepted")
    )
