"""A stored dictionary of symbols: names are found under their rarest piece.

Every distinct symbol (with its parent) is filed under its pieces of up to three letters, and each
piece knows how many symbols hold it. A name is looked up under the piece of its own that fewest
symbols hold, the match is verified, and only then are the chunks of the matching symbols named,
from a narrow table in folders by symbol. Text is joined to the hits that are returned, so nothing
reads the chunks before. Symbols of a frequent piece are dealt to parts of about ``PART_ROWS``.

Defined results: those of ``lookup.find_symbol``, plus ``matches``, the number of chunks that match,
so that a caller sees what a limit left out; names without a letter find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import secrets, text
from textquarry.operators.lookup import EXCERPT_CHARS, GRAM, symbol_label, symbol_pieces
from textquarry.operators.near_duplicates import join_by_share
from textquarry.session import cut_lineage
from textquarry.sources.sinks import in_folders

PART_ROWS = 50_000
BUCKETS = 32


@dataclass(frozen=True)
class SymbolIndex:
    """``pieces``: bucket, repository_id, piece, part, label; ``counts``: repository_id, piece, symbols,
    parts; ``holders``: bucket, repository_id, label, chunk_id, symbol, path, start_line."""

    pieces: DataFrame
    counts: DataFrame
    holders: DataFrame


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def build_symbols(chunks: DataFrame, part_rows: int = PART_ROWS) -> SymbolIndex:
    keyed = chunks.withColumn("label", symbol_label()).where("label <> ''")
    holders = keyed.select(_bucket(F.col("label")).alias("bucket"), "repository_id", "label", "chunk_id", "symbol", "path", "start_line")
    labels = cut_lineage(keyed.select("repository_id", "label").distinct())
    filed = labels.select("repository_id", "label", F.explode(symbol_pieces(F.col("label"))).alias("piece"))
    counts = filed.groupBy("repository_id", "piece").agg(F.count("*").alias("symbols"))
    counts = cut_lineage(counts.withColumn("parts", F.ceil(F.col("symbols") / part_rows).cast("int")))
    keys = F.concat_ws("\x00", "repository_id", "piece")
    placed = join_by_share(filed.withColumn("_key", keys), counts.select(keys.alias("_key"), "symbols", "parts"), "_key", "symbols")
    pieces = placed.select(
        _bucket(F.col("piece")).alias("bucket"), "repository_id", "piece", F.pmod(F.xxhash64("label"), "parts").cast("int").alias("part"), "label"
    )
    return SymbolIndex(pieces, counts, holders)


def name_pieces(name: Column) -> Column:
    """The longest pieces of a name, of three letters if it has as many."""
    size = F.least(F.length(name), F.lit(GRAM))
    starts = F.sequence(F.lit(1), F.length(name) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, size)))


def matching_labels(names: DataFrame, index: SymbolIndex) -> DataFrame:
    """(request_id, repository_id, name, label) of all symbols that contain a name."""
    wanted = names.select("request_id", "repository_id", F.lower(F.trim("name")).alias("name")).where("name <> ''")
    asked = wanted.withColumn("piece", F.explode(name_pieces(F.col("name"))))
    counted = asked.join(index.counts, ["repository_id", "piece"], "left")
    rarest = counted.groupBy("request_id", "repository_id", "name").agg(
        F.min_by(F.struct("piece", "parts"), F.struct(F.coalesce("symbols", F.lit(0)), "piece")).alias("least")
    ).where("least.parts IS NOT NULL")
    parts = F.explode(F.sequence(F.lit(0), F.col("least.parts") - 1)).alias("part")
    looked_up = rarest.select("request_id", "repository_id", "name", F.col("least.piece").alias("piece"), _bucket(F.col("least.piece")).alias("bucket"), parts)
    looked_up = cut_lineage(looked_up)
    return (
        in_folders(index.pieces, "bucket", looked_up).join(looked_up, ["bucket", "repository_id", "piece", "part"])
        .where(F.contains("label", "name"))
        .select("request_id", "repository_id", "name", "label")
    )


def find_symbol(names: DataFrame, index: SymbolIndex, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks whose symbol or parent contains a name, exact first, then shorter ones, with ``matches`` per request."""
    hits = cut_lineage(matching_labels(names, index).withColumn("bucket", _bucket(F.col("label"))))
    held = in_folders(index.holders, "bucket", hits).join(hits, ["bucket", "repository_id", "label"])
    order = Window.partitionBy("request_id").orderBy(
        F.desc((F.coalesce(F.lower("symbol"), F.lit("")) == F.col("name")).cast("int")),
        F.length(F.coalesce("symbol", F.lit(""))), "path", "start_line", "chunk_id",
    )
    held = cut_lineage(held.select("request_id", "chunk_id", "symbol", "name", "path", "start_line"))
    counts = held.groupBy("request_id").agg(F.count("*").alias("matches"))
    best = held.withColumn("match_rank", F.row_number().over(order)).where(F.col("match_rank") <= limit)
    top = cut_lineage(best.select("request_id", "chunk_id", "match_rank").join(counts, "request_id"))
    return chunks.join(top, "chunk_id").withColumn("excerpt", text.cut_at_newline(secrets.redact(F.col("content")), EXCERPT_CHARS))
