"""Anchored edits: validation, location, application and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import paths, text
from textquarry.settings import EDITS, EditLimits

FILE_KEYS = ["repository_id", "path"]


def validate_edits(edits: DataFrame, limits: EditLimits = EDITS) -> DataFrame:
    """Adds ``rejected``: the first reason an edit cannot be used, null when it can.

    ``edits`` has proposal_id, repository_id, path, old_text, new_text. The size of a proposal
    is an aggregate joined back, so one enormous proposal is never gathered in a task.
    """
    sizes = edits.groupBy("proposal_id").agg(F.count("*").alias("_edits"))
    reason = (
        F.when(F.col("_edits") > limits.max_edits, "too_many_edits")
        .when(text.is_blank(F.coalesce("path", F.lit(""))), "no_path")
        .when(F.col("old_text").isNull() | F.col("new_text").isNull(), "missing_text")
        .when(F.col("old_text") == F.col("new_text"), "no_change")
        .when(text.is_blank(F.col("old_text")), "blank_anchor")
        .when(~paths.in_repository_scope(F.col("path"), limits.max_path_chars), "path_out_of_scope")
    )
    return edits.join(sizes, "proposal_id").withColumn("rejected", reason).drop("_edits")


def _adapt_breaks(quoted: Column, original: Column) -> Column:
    """Quotes carry plain newlines; a file with CRLF keeps its own convention."""
    plain = F.replace(quoted, F.lit("\r\n"), F.lit("\n"))
    return F.when(
        original.contains("\r\n"), F.replace(plain, F.lit("\n"), F.lit("\r\n"))
    ).otherwise(quoted)


def locate_anchors(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Adds where each quoted text sits in the original file and how often it occurs.

    Offsets are 1-based characters, lines 1-based inclusive; both are null unless the anchor
    occurs exactly once.
    """
    original = F.col("_original")
    joined = edits.join(files.select(*FILE_KEYS, F.col("content").alias("_original")), FILE_KEYS, "left")
    adapted = joined.withColumn("anchor", _adapt_breaks(F.col("old_text"), original)).withColumn(
        "replacement", _adapt_breaks(F.col("new_text"), original)
    )
    removed = F.replace(original, F.col("anchor"), F.lit(""))
    occurrences = F.coalesce(
        F.try_divide(F.length(original) - F.length(removed), F.length("anchor")).cast("int"), F.lit(0)
    )
    once = F.col("occurrences") == 1
    start = F.when(once, F.position(F.col("anchor"), original))
    before = F.left(original, F.col("anchor_start") - 1)
    inner = F.left(F.col("anchor"), F.length("anchor") - 1)
    first_line = text.count_char(before, "\n") + 1
    return (
        adapted.withColumn("occurrences", occurrences)
        .withColumn("anchor_start", start)
        .withColumn("anchor_end", F.col("anchor_start") + F.length("anchor"))
        .withColumn("start_line", F.when(once, first_line))
        .withColumn("end_line", F.when(once, F.col("start_line") + text.count_char(inner, "\n")))
        .withColumn(
            "anchor_status",
            F.when(original.isNull(), "file_missing")
            .when(F.col("occurrences") == 0, "not_found")
            .when(once, "unique")
            .otherwise("ambiguous"),
        )
        .drop("_original")
    )


def overlapping_anchors(anchors: DataFrame) -> DataFrame:
    """Unique anchors of one proposal and file whose quoted texts overlap."""
    order = Window.partitionBy("proposal_id", *FILE_KEYS).orderBy("anchor_start", "anchor_end")
    return (
        anchors.where("anchor_status = 'unique'")
        .withColumn("previous_end", F.lag("anchor_end").over(order))
        .where(F.col("anchor_start") < F.col("previous_end"))
    )


def file_scope(edits: DataFrame, files: DataFrame, reads: DataFrame) -> DataFrame:
    """Adds ``scope``: allowed, not_read (by the investigation) or not_indexed."""
    read = reads.select("proposal_id", "path").distinct().withColumn("_read", F.lit(True))
    indexed = files.select(*FILE_KEYS).distinct().withColumn("_indexed", F.lit(True))
    return (
        edits.join(read, ["proposal_id", "path"], "left")
        .join(indexed, FILE_KEYS, "left")
        .withColumn(
            "scope",
            F.when(F.col("_read").isNull(), "not_read")
            .when(F.col("_indexed").isNull(), "not_indexed")
            .otherwise("allowed"),
        )
        .drop("_read", "_indexed")
    )


def apply_edits(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Updated content per proposal and file, all replacements spliced into the original.

    A file takes part only when each of its edits is unique and none overlap. Its edits are at
    most ``max_edits``, so one file's edits fit in one array.
    """
    grouped = anchors.groupBy("proposal_id", *FILE_KEYS).agg(
        F.count("*").alias("edits"),
        F.count_if(F.col("anchor_status") == "unique").alias("_unique"),
        F.array_sort(
            F.collect_list(F.struct("anchor_start", "anchor_end", "replacement"))
        ).alias("_spans"),
    )
    spans = F.col("_spans")
    clash = F.exists(
        F.sequence(F.lit(1), F.size(spans)),
        lambda i: F.coalesce(
            F.element_at(spans, i)["anchor_end"] > F.try_element_at(spans, i + 1)["anchor_start"], F.lit(False)
        ),
    )
    original = F.col("original")

    def piece(span: Column, i: Column) -> Column:
        earlier = F.when(i > 0, F.try_element_at(spans, F.greatest(i, F.lit(1)))["anchor_end"]).otherwise(1)
        kept = F.substring(original, earlier, span["anchor_start"] - earlier)
        return F.concat(kept, span["replacement"])

    tail = F.substring(original, F.element_at(spans, -1)["anchor_end"], F.length(original))
    updated = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    return (
        grouped.where((F.col("edits") == F.col("_unique")) & ~clash)
        .join(files.select(*FILE_KEYS, "blob_sha", F.col("content").alias("original")), FILE_KEYS)
        .withColumn("updated", updated)
        .drop("_unique", "_spans")
    )


def stale_changes(
    changes: DataFrame, repositories: DataFrame, change_files: DataFrame, files: DataFrame, anchors: DataFrame
) -> DataFrame:
    """Adds why a pending change no longer describes the indexed source.

    ``changes``: change_id, repository_id, status, indexed_commit_sha. ``repositories``:
    repository_id, current_commit_sha. ``change_files``: change_id, path, blob_sha.
    ``anchors``: proposal_id, anchor_status. An unknown commit on either side is not stale.
    """
    blobs = (
        changes.select("change_id", "repository_id")
        .join(change_files, "change_id")
        .join(files.select(*FILE_KEYS, F.col("blob_sha").alias("_now")), FILE_KEYS, "left")
        .groupBy("change_id")
        .agg(F.bool_or(~F.col("_now").eqNullSafe(F.col("blob_sha"))).alias("_moved"))
    )
    quotes = anchors.groupBy(F.col("proposal_id").alias("change_id")).agg(
        F.bool_or(F.col("anchor_status") != "unique").alias("_lost")
    )
    reason = (
        F.when(F.col("indexed_commit_sha") != F.col("current_commit_sha"), "snapshot_moved")
        .when(F.col("_moved"), "file_changed")
        .when(F.col("_lost"), "anchor_lost")
    )
    pending = F.col("status").isin("proposed", "approved")
    return (
        changes.join(repositories.select("repository_id", "current_commit_sha"), "repository_id", "left")
        .join(blobs, "change_id", "left")
        .join(quotes, "change_id", "left")
        .withColumn("stale_reason", F.when(pending, reason))
        .drop("_moved", "_lost")
    )


def live_branch_check(changes: DataFrame, change_files: DataFrame, live_files: DataFrame) -> DataFrame:
    """Whether a change still applies to the live branch, and the commit to build on.

    ``changes``: change_id, repository_id, base_sha, head_sha; ``live_files``: repository_id,
    path, live_blob. A moved head is fine while every changed file is the validated blob.
    """
    same = (
        changes.select("change_id", "repository_id")
        .join(change_files, "change_id")
        .join(live_files, FILE_KEYS, "left")
        .groupBy("change_id")
        .agg(F.bool_and(F.col("live_blob").eqNullSafe(F.col("blob_sha"))).alias("_same"))
    )
    good = (F.col("head_sha") == F.col("base_sha")) | F.coalesce("_same", F.lit(True))
    return (
        changes.join(same, "change_id", "left")
        .withColumn("live_status", F.when(good, "current").otherwise("stale"))
        .withColumn("build_on", F.when(good, F.col("head_sha")))
        .drop("_same")
    )
