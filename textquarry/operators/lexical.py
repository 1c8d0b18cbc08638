"""Inverted index, term statistics and full-text search for tables of questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.functions import terms
from textquarry.session import cut_lineage

NAME_WEIGHT = 1.0
BODY_WEIGHT = 0.1
RANK_DIGITS = 9


def name_text() -> Column:
    return F.concat_ws(" ", "path", F.nullif("parent_symbol", F.lit("")), F.nullif("symbol", F.lit("")))


def name_terms() -> Column:
    """Terms of path, parent and symbol."""
    return terms.text_terms(name_text())


def lexical_fields(chunks: DataFrame) -> DataFrame:
    """Adds ``names`` (path, parent and symbol) and ``body`` (content) term arrays."""
    return chunks.withColumn("names", name_terms()).withColumn("body", terms.text_terms(F.col("content")))


def packed_postings(chunks: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Inverted index as it is stored: one row per chunk, with its terms and their field frequencies.

    The terms of a chunk are counted inside its own row, so nothing is shuffled, and a join by chunk
    moves one row, not one per term. Columns of chunks to ``carry`` follow.
    """
    counted = chunks.select("repository_id", "chunk_id", *carry, terms.field_terms(name_text(), F.col("content")).alias("_found"))
    return counted.select(
        "repository_id", "chunk_id", F.col("_found.total").cast("int").alias("chunk_terms"), *carry, F.col("_found.terms").alias("terms")
    )


POSTING = ("repository_id", "term", "chunk_id", "tf_names", "tf_body", "chunk_terms")


def unpacked(postings: DataFrame) -> DataFrame:
    """One row per chunk and term; rows of a chunk stay together."""
    if "terms" not in postings.columns:
        return postings
    carry = [c for c in postings.columns if c not in (*POSTING, "terms")]
    rows = postings.select("repository_id", "chunk_id", "chunk_terms", *carry, F.inline("terms"))
    return rows.select(*POSTING, *carry)


def packed(postings: DataFrame) -> DataFrame:
    """One row per chunk, also of postings that come as one row per term."""
    if "terms" in postings.columns:
        return postings
    carry = [c for c in postings.columns if c not in POSTING]
    hit = F.struct("term", F.col("tf_names").cast("bigint").alias("tf_names"), F.col("tf_body").cast("bigint").alias("tf_body"))
    return postings.groupBy("repository_id", "chunk_id", "chunk_terms", *carry).agg(F.collect_list(hit).alias("terms"))


def build_postings(chunks: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Inverted index: one row per repository, chunk and term with its field frequencies."""
    return unpacked(packed_postings(chunks, carry))


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per query and distinct term, in order of appearance."""
    return queries.select(
        "query_id", "repository_id",
        F.posexplode(terms.question_terms(F.col("text"))).alias("position", "term"),
    )


def query_identifiers(queries: DataFrame) -> DataFrame:
    """Adds the code-looking tokens of each question, as typed."""
    return queries.withColumn("identifiers", terms.question_identifiers(F.col("text")))


def term_statistics(
    postings: DataFrame, chunks: DataFrame, query_term_rows: DataFrame
) -> DataFrame:
    """Per repository and asked term: chunk count, document frequency, idf, informativeness.

    Postings are reduced by a semi join on the asked terms before counting; the counts combine
    map-side, so a frequent term costs no more than a rare one after the shuffle.
    """
    asked = query_term_rows.select("repository_id", "term").distinct()
    # Of packed postings only the names of terms are read.
    named = postings.select("repository_id", F.explode("terms.term").alias("term")) if "terms" in postings.columns else postings
    frequency = (
        named.join(asked, ["repository_id", "term"], "left_semi")
        .groupBy("repository_id", "term")
        .agg(F.count("*").alias("df"))
    )
    totals = chunks.groupBy("repository_id").agg(F.count("*").alias("total_chunks"))
    lexical = (
        postings.where(F.array_max(F.col("terms.tf_body")) > 0 if "terms" in postings.columns else F.expr("tf_body > 0"))
        .groupBy("repository_id")
        .agg(F.lit(True).alias("lexical_available"))
    )
    stats = (
        asked.join(frequency, ["repository_id", "term"], "left")
        .join(totals, "repository_id", "left")
        .join(lexical, "repository_id", "left")
        .select(
            "repository_id",
            "term",
            F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"),
            F.coalesce("df", F.lit(0)).alias("df"),
            F.coalesce("lexical_available", F.lit(False)).alias("lexical_available"),
        )
    )
    return stats.withColumn("idf", idf(F.col("total_chunks"), F.col("df"))).withColumn(
        "informative", is_informative(F.col("total_chunks"), F.col("df"))
    )


def idf(total: Column, df: Column) -> Column:
    n = F.greatest(total, F.lit(1))
    return F.ln(1.0 + (n - df + 0.5) / (df + 0.5))


def is_informative(total: Column, df: Column) -> Column:
    return df * 2 <= F.greatest(total, F.lit(1))


def searchable_terms(stats: DataFrame, query_term_rows: DataFrame) -> DataFrame:
    """Asked terms worth looking up: those in no or in most chunks are left out."""
    known = stats.where("df > 0 and informative and lexical_available")
    return query_term_rows.join(known.select("repository_id", "term", "idf"), ["repository_id", "term"])


def text_rank() -> Column:
    """Weighted term frequency, damped by the length of the chunk."""
    weighted = F.sum(F.col("tf_names") * NAME_WEIGHT + F.col("tf_body") * BODY_WEIGHT)
    return F.round(weighted / (1 + F.ln(F.max("chunk_terms").cast("double"))), RANK_DIGITS)


def whole_chunks(postings: DataFrame) -> DataFrame:
    """Packed postings with one row per chunk id: rows that repeat an id, of which there are few, are added up."""
    rows = packed(postings).select("repository_id", "chunk_id", "chunk_terms", "terms")
    keys = ["repository_id", "chunk_id"]
    twice = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if twice.isEmpty():
        return rows
    again = unpacked(rows.join(twice, keys, "left_semi")).groupBy(*keys, "term").agg(
        F.sum("tf_names").alias("tf_names"), F.sum("tf_body").alias("tf_body"), F.max("chunk_terms").alias("_length")
    )
    again = again.groupBy(*keys).agg(
        F.max("_length").alias("chunk_terms"), F.collect_list(F.struct("term", "tf_names", "tf_body")).alias("terms")
    )
    return rows.join(twice, keys, "left_anti").unionByName(again)


BLOCK_CHUNKS = 512
BLOCK_QUERIES = 256
BROADCAST_TERMS = 50_000
PACKED_BLOCK = "repository_id string, ids array<string>, lengths binary, sizes binary, names array<string>, codes binary, weights binary"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one repository, at most BLOCK_CHUNKS, as a block; its distinct terms are named once."""
    for batch in batches:
        repositories = batch.column("repository_id").to_pylist()
        edges = [i for i in range(1, len(repositories)) if repositories[i] != repositories[i - 1]]
        for low, high in zip([0, *edges], [*edges, len(repositories)]):
            for at in range(low, high, BLOCK_CHUNKS):
                piece = batch.slice(at, min(BLOCK_CHUNKS, high - at))
                hits = piece.column("terms").flatten()
                coded = hits.field("term").dictionary_encode()
                tf = [hits.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tf_names", "tf_body")]
                sizes = pc.list_value_length(piece.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = piece.column("chunk_terms").to_numpy(zero_copy_only=False).astype(np.float64)
                binary = lambda values: pa.array([values.tobytes()], pa.binary())
                yield pa.record_batch(
                    {
                        "repository_id": pa.array([repositories[at]], pa.string()),
                        "ids": pa.array([piece.column("chunk_id").to_pylist()], pa.list_(pa.string())),
                        "lengths": binary(lengths),
                        "sizes": binary(sizes),
                        "names": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                        "codes": binary(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)),
                        "weights": binary(tf[0] * NAME_WEIGHT + tf[1] * BODY_WEIGHT),
                    }
                )


class _Asked:
    """The looked-up terms of some queries."""

    def __init__(self, rows: list[dict]):
        self.queries = list(dict.fromkeys(r["query_id"] for r in rows))
        place = {q: i for i, q in enumerate(self.queries)}
        self.terms = list(dict.fromkeys(r["term"] for r in rows))
        at = {t: i for i, t in enumerate(self.terms)}
        self.asked = np.zeros((len(self.terms), len(self.queries)))
        self.idf = np.zeros_like(self.asked)
        self.ordered: list[list[tuple[int, str]]] = [[] for _ in self.queries]
        for r in sorted(rows, key=lambda r: (r["position"], r["term"])):
            t, q = at[r["term"]], place[r["query_id"]]
            self.asked[t, q] += 1
            self.idf[t, q] += r["idf"]
            self.ordered[q].append((t, r["term"]))
        self.best = [np.zeros(0) for _ in self.queries]  # best ranks this task has met


HIT = ("query_id", "chunk_id", "text_rank", "matched_idf", "matched_terms")


def hit_schema(query_type: str) -> str:
    return f"query_id {query_type}, chunk_id string, text_rank double, matched_idf double, matched_terms array<string>"


def ranks_of(weights: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Text rank, chunks x queries, from the weight of each term in each chunk."""
    return np.round(weights @ wanted / (1 + np.log(np.maximum(lengths, 1)[:, None])), RANK_DIGITS)


def best_hits(
    weights: np.ndarray, held: np.ndarray, lengths: np.ndarray, ids: list[str], asked: _Asked, limit: int, queries: np.ndarray
) -> Iterator[tuple]:
    """The hits of some queries among some chunks that can still be wanted; ``weights``: chunks x held terms."""
    present, wanted = weights > 0, asked.asked[np.ix_(held, queries)]
    matched = present.astype(np.float64) @ wanted > 0
    idf = present.astype(np.float64) @ asked.idf[np.ix_(held, queries)]
    ranks = ranks_of(weights, wanted, lengths)
    slot = {t: i for i, t in enumerate(held.tolist())}
    for column in np.flatnonzero(matched.any(axis=0)).tolist():
        q = int(queries[column])
        line, best = ranks[:, column], asked.best[q]
        good = matched[:, column] & (line >= best.min()) if len(best) == limit else matched[:, column]
        chosen = np.flatnonzero(good)
        if len(chosen) > limit:
            # Ranks are settled by the chunk's id, so no more than these can be wanted.
            kth = np.partition(line[chosen], len(chosen) - limit)[len(chosen) - limit]
            tied = sorted(chosen[line[chosen] == kth].tolist(), key=ids.__getitem__)
            above = chosen[line[chosen] > kth].tolist()
            chosen = np.array(above + tied[: limit - len(above)], np.int64)
        ranked = np.concatenate([best, line[chosen]])
        asked.best[q] = np.partition(ranked, len(ranked) - limit)[-limit:] if len(ranked) > limit else ranked
        for c in chosen.tolist():
            terms = [term for t, term in asked.ordered[q] if t in slot and present[c, slot[t]]]
            yield asked.queries[q], ids[c], line[c], idf[c, column], terms


def _block_hits(limit: int, query_type: pa.DataType):
    def hits(block: dict, asked: _Asked) -> Iterator[tuple]:
        sizes, codes = np.frombuffer(block["sizes"], np.int64), np.frombuffer(block["codes"], np.int32)
        at = {t: i for i, t in enumerate(asked.terms)}
        column = np.array([at.get(name, -1) for name in block["names"]], np.int64)
        found = column[codes] if len(codes) else np.zeros(0, np.int64)
        row, some = np.repeat(np.arange(len(sizes)), sizes), found >= 0
        held = np.unique(found[some])
        place = row[some] * len(held) + np.searchsorted(held, found[some])
        weights = np.bincount(place, np.frombuffer(block["weights"])[some], len(sizes) * len(held)).reshape(len(sizes), len(held))
        yield from best_hits(weights, held, np.frombuffer(block["lengths"]), block["ids"], asked, limit, np.arange(len(asked.queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("repository_id")[i].as_py(), batch.column("part")[i].as_py())
                if key not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[key] = _Asked(batch.column("asked")[i].as_py())
                block = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "sizes", "names", "codes", "weights")}
                rows = list(hits(block, known[key]))
                if rows:
                    query, chunk, rank, idf, terms = zip(*rows)
                    yield pa.record_batch(
                        {
                            "query_id": pa.array(query, query_type),
                            "chunk_id": pa.array(chunk, pa.string()),
                            "text_rank": pa.array(rank, pa.float64()),
                            "matched_idf": pa.array(idf, pa.float64()),
                            "matched_terms": pa.array(terms, pa.list_(pa.string())),
                        }
                    )

    return run


def lexical_search(
    postings: DataFrame, stats: DataFrame, query_term_rows: DataFrame, limit: int, salts: int = 32
) -> DataFrame:
    """Top chunks per query by text rank, with the matched terms in question order.

    Chunks are packed into blocks and meet blocks of queries; a task keeps only hits that can still
    be among the best, so neither postings nor (query, chunk) rows are shuffled. The looked-up terms
    are counted: they are broadcast up to BROADCAST_TERMS rows, and beyond that query blocks are
    copied to ``salts`` keys, over which the blocks of a repository are spread.
    """
    searchable = cut_lineage(searchable_terms(stats, query_term_rows))
    size = searchable.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries")).first()
    parts = max(1, -(-size["queries"] // BLOCK_QUERIES))
    asked = searchable.groupBy("repository_id", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(
        F.collect_list(F.struct("query_id", "position", "term", "idf")).alias("asked")
    )
    blocks = whole_chunks(postings).select("repository_id", "chunk_id", "chunk_terms", "terms").mapInArrow(_pack_blocks, PACKED_BLOCK)
    if size["rows"] <= BROADCAST_TERMS:
        pairs = blocks.join(F.broadcast(asked), "repository_id")
    else:
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
        pairs = blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).join(asked.withColumn("salt", copies), ["repository_id", "salt"])
    query_type = searchable.schema["query_id"].dataType
    hits = pairs.select("repository_id", "part", "ids", "lengths", "sizes", "names", "codes", "weights", "asked").mapInArrow(
        _block_hits(limit, to_arrow_type(query_type)), hit_schema(query_type.simpleString())
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("text_rank"), "chunk_id")
    top = hits.withColumn("text_position", F.row_number().over(best)).where(F.col("text_position") <= limit)
    return top.select("query_id", "chunk_id", "text_rank", "matched_idf", "text_position", "matched_terms")


def coverage(hits: DataFrame, stats: DataFrame, query_term_rows: DataFrame) -> DataFrame:
    """Adds ``coverage``: the matched share of the question's informative idf weight.

    Terms found in no chunk stay in the denominator.
    """
    weight = (
        query_term_rows.join(stats.where("informative"), ["repository_id", "term"])
        .groupBy("query_id")
        .agg(F.sum("idf").alias("_total_idf"))
    )
    return (
        hits.join(weight, "query_id", "left")
        .withColumn(
            "coverage",
            F.round(
                F.coalesce(F.try_divide("matched_idf", "_total_idf"), F.lit(0.0)), RANK_DIGITS
            ),
        )
        .drop("_total_idf", "matched_idf")
    )
