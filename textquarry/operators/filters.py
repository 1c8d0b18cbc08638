"""Which files of a manifest are indexed, and why the others are not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import paths, text
from textquarry.session import cut_lineage
from textquarry.settings import INDEX, IndexLimits

UNLIMITED = 1 << 62
BINARY_WINDOW_BYTES = 8_000


def detect_language(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds language, content_type and parseable; null language means unsupported."""
    return (
        df.withColumn("_language", paths.language_of(F.col(path_col)))
        .withColumn("language", F.col("_language.slug"))
        .withColumn("content_type", F.col("_language.content_type"))
        .withColumn("parseable", F.col("_language.parseable"))
        .drop("_language")
    )


def metadata_reason(max_file_bytes: int | None) -> Column:
    """First matching reason from metadata alone; null when the entry may be fetched."""
    size = F.coalesce(F.col("size"), F.lit(0))
    return (
        F.when(F.col("type") == "commit", "submodule")
        .when(F.col("type") != "blob", "unsupported_type")
        .otherwise(
            F.coalesce(
                paths.exclusion_reason(F.col("path")),
                F.when(F.col("language").isNull(), "unsupported_type")
                .when(size == 0, "empty")
                .when(F.lit(False) if max_file_bytes is None else size > max_file_bytes, "too_large"),
            )
        )
    )


def metadata_decision(manifest: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """A reason that the manifest brings (a file that can't be read) comes first."""
    reason = metadata_reason(limits.max_file_bytes)
    if "skip_reason" in manifest.columns:
        reason = F.coalesce("skip_reason", reason)
    return detect_language(manifest).withColumn("skip_reason", reason)


def _bounds(limits: IndexLimits) -> tuple[int, int]:
    """The byte and file limits as numbers."""
    given = (limits.max_total_bytes, limits.max_files)
    return tuple(UNLIMITED if limit is None else limit for limit in given)


def _greedy_fit(limits: IndexLimits):
    """Walk candidates in manifest order; needs only the running totals."""

    max_total_bytes, max_files = _bounds(limits)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", kind="stable")
        left, files, keep, full_at = max_total_bytes, 0, [], None
        for pos, size in zip(rows["pos"].tolist(), rows["size"].tolist()):
            fits = files < max_files and size <= left
            if fits:
                files, left = files + 1, left - size
                full_at = pos if files == max_files else full_at
            keep.append(fits)
        out = rows.loc[keep, ["repository_id", "pos"]].assign(accepted=True)
        marker = pd.DataFrame(
            {"repository_id": [rows["repository_id"].iloc[0]], "pos": [full_at], "accepted": [False]}
        )
        return pd.concat([out, marker]) if full_at is not None else out

    return walk


def budget_candidates(accepted: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Rows that could be accepted by the budget walk; everything else provably cannot.

    Sizes fall into classes [2^c, 2^(c+1)). While the remaining budget covers a whole class,
    each of its files is accepted, which can happen at most K = min(max_files, total / 2^c)
    times. Afterwards at most one more file of the class fits, and it must be smaller than
    every file of the class rejected before it. So the first K + 1 files of a class and the
    running minima after them suffice. Per repository that is at most a constant number of
    (pos, size) rows, set by the limits: about max_files for each size class, and no more
    minima than there are sizes up to max_file_bytes.
    """
    max_total_bytes, max_files = _bounds(limits)
    # The top bit of the size, from its binary text: exact where a logarithm would round.
    size_class = (F.length(F.bin("size")) - 1).alias("size_class")
    # Three narrow columns, judged once and read several times below.
    sized = cut_lineage(accepted.select("repository_id", "pos", "size", size_class))
    quota = (
        F.least(
            F.lit(max_files),
            F.floor(F.lit(max_total_bytes) / F.pow(F.lit(2.0), F.col("size_class"))),
        )
        + 1
    )
    by_class = ["repository_id", "size_class"]
    order = Window.partitionBy(*by_class).orderBy("pos")
    heads = (
        sized.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= max_files + 1)  # constant bound, pushed below the shuffle
        .where(F.col("_n") <= quota)
    )
    last_head = heads.groupBy(*by_class).agg(F.max("pos").alias("_last"))
    later = sized.join(last_head, by_class).where(F.col("pos") > F.col("_last"))
    # Running minima in two steps, so one huge class is spread over position blocks.
    block = F.floor(F.col("pos") / 65_536).alias("block")
    in_block = Window.partitionBy(*by_class, "block").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1
    )
    local_minima = (
        later.select("*", block)
        .withColumn("_before", F.min("size").over(in_block))
        .where(F.col("_before").isNull() | (F.col("size") < F.col("_before")))
    )
    over_blocks = Window.partitionBy(*by_class).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    block_minima = (
        local_minima.groupBy(*by_class, "block")
        .agg(F.min("size").alias("_least"))
        .withColumn("_earlier", F.min("_least").over(over_blocks))
    )
    minima = local_minima.join(block_minima, [*by_class, "block"]).where(
        F.col("_earlier").isNull() | (F.col("size") < F.col("_earlier"))
    )
    columns = ["repository_id", "pos", "size"]
    return heads.select(*columns).unionByName(minima.select(*columns))


def apply_budgets(accepted: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Greedy file and byte budget per repository in ``pos`` order, skipping what does not fit.

    ``pos`` must be unique per repository. The order-dependent walk sees the bounded candidate
    rows only; all other rows are judged by join. Without limits every file is accepted as it is.
    """
    if limits.max_total_bytes is None and limits.max_files is None:
        return accepted.withColumn("skip_reason", F.lit(None).cast("string"))
    verdicts = (
        budget_candidates(accepted, limits)
        .groupBy("repository_id")
        .applyInPandas(
            _greedy_fit(limits), "repository_id string, pos bigint, accepted boolean"
        )
    )
    fits = verdicts.where("accepted").select("repository_id", "pos", F.lit(True).alias("_fits"))
    full = verdicts.where("not accepted").select("repository_id", F.col("pos").alias("_full_at"))
    return (
        accepted.join(fits, ["repository_id", "pos"], "left")
        .join(full, "repository_id", "left")
        .withColumn(
            "skip_reason",
            F.when(F.col("_fits"), F.lit(None).cast("string"))
            .when(F.col("pos") > F.col("_full_at"), "file_limit_reached")
            .otherwise("byte_budget_reached"),
        )
        .drop("_fits", "_full_at")
    )


def dedupe_by_blob(accepted: DataFrame) -> DataFrame:
    """One row per repository and blob: the last manifest entry wins.

    Only positions are aggregated (with map-side combine); wide columns come back by join. It goes by
    repository and position alone, so rows that are dealt by these stay where they are, and the
    narrow side is hashed, so wide rows are not sorted either.
    """
    last = accepted.groupBy("repository_id", "sha").agg(F.max("pos").alias("pos"))
    kept = last.groupBy("repository_id", "pos").agg(F.collect_set("sha").alias("_kept"))
    found = accepted.join(kept.hint("shuffle_hash"), ["repository_id", "pos"])
    return found.where(F.array_contains("_kept", F.col("sha"))).select(*accepted.columns)


def content_reason(content: Column, window_bytes: int | None = BINARY_WINDOW_BYTES) -> Column:
    """binary, decode_failed, empty or null, from raw bytes.

    A NUL within the first ``window_bytes`` makes a file binary; None looks at all bytes.
    """
    decoded = content.cast("string")  # bytes are kept as they are, valid or not
    looked_at = content if window_bytes is None else F.substring(content, 1, window_bytes)
    has_nul = F.position(F.lit(b"\x00"), looked_at) > 0
    return (
        F.when(has_nul, "binary")
        .when(~F.is_valid_utf8(decoded), "decode_failed")
        .when(text.is_blank(decoded), "empty")
    )


def content_decision(
    df: DataFrame, content_col: str = "content", window_bytes: int | None = BINARY_WINDOW_BYTES
) -> DataFrame:
    return df.withColumn("skip_reason", content_reason(F.col(content_col), window_bytes))


def prepare_files(df: DataFrame) -> DataFrame:
    """File rows for the index. ``df`` carries text content and language columns.

    A parse error is what a producer of spans reports in a ``syntax_error`` column, for a file in
    which it found no span; a file that merely declares nothing is parsed.
    """
    out = detect_language(df) if "language" not in df.columns else df
    has_spans = F.col("has_spans") if "has_spans" in df.columns else F.lit(False)
    failed = F.col("syntax_error") if "syntax_error" in df.columns else F.lit(False)
    parse_error = F.when(F.col("parseable") & failed & ~has_spans, "syntax")
    return out.select(
        "repository_id",
        "path",
        F.col("sha").alias("blob_sha"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        (text.count_char(F.col("content"), "\n") + 1).cast("bigint").alias("line_count"),
        "language",
        "content_type",
        "content",
        (F.coalesce(F.col("parseable"), F.lit(False)) & parse_error.isNull()).alias("is_parsed"),
        parse_error.alias("parse_error"),
    )


def skip_report(decisions: DataFrame) -> DataFrame:
    """Skips per repository and reason, and each repository's total."""
    skipped = decisions.where(F.col("skip_reason").isNotNull())
    counted = skipped.groupBy("repository_id", "skip_reason").agg(F.count("*").alias("skipped"))
    total = Window.partitionBy("repository_id")  # at most ten reasons per repository
    return counted.withColumn("total_skipped", F.sum("skipped").over(total))


def valid_repository_path(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.withColumn("allowed", paths.in_repository_scope(F.col(path_col)))


def validate_queries(
    queries: DataFrame, max_chars: int = 2_000, max_top_k: int = 50
) -> DataFrame:
    """Trimmed text, and the reason a request is refused (null when it is fine)."""
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return queries.withColumn("text", trimmed).withColumn(
        "rejected",
        F.when(F.coalesce(F.col("text"), F.lit("")) == "", "blank")
        .when(F.length("text") > max_chars, "too_long")
        .when(~F.col("top_k").between(1, max_top_k), "top_k_out_of_range"),
    )
