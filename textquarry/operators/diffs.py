"""Unified diffs: rendering, line numbering, counts and verification."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.operators.lookup import file_lines
from textquarry.settings import EDITS, EditLimits

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
KEYS = ["change_id", "path"]
ROWS_AT_ONCE = 64  # whole files, of which Python holds no more at a time


def unified_diff(pairs: DataFrame, context: int = EDITS.diff_context) -> DataFrame:
    """Adds ``diff`` for rows with path, original and updated; files are diffed independently."""
    schema = pairs.withColumn("diff", F.lit("")).schema

    def diff(path: str, old: str, new: str) -> str:
        lines = difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{path}", f"b/{path}", n=context, lineterm="")
        return "\n".join(lines)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                texts = (rows.column(c).to_pylist() for c in ("path", "original", "updated"))
                yield rows.append_column("diff", pa.array([diff(*row) for row in zip(*texts)], pa.string()))

    return pairs.mapInArrow(render, schema)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """One row per diff line with kind and left/right line numbers.

    ``diffs`` has change_id and diff (one or several files). A hunk is read by the line counts of
    its header: until both are used up every line is content, whatever it looks like, and after
    that lines name the next file. Content that begins with none of blank, plus, minus and
    backslash is of kind ``malformed``. A change is bounded by its edit limits.
    """
    change = Window.partitionBy("change_id").orderBy("pos")
    raw = F.col("raw")
    rows = diffs.select("change_id", F.posexplode(F.split("diff", "\n")).alias("pos", "raw"))
    header = raw.rlike(HUNK)  # content never begins with an at sign
    hunked = rows.withColumn("hunk", F.sum(header.cast("int")).over(change))
    in_hunk = Window.partitionBy("change_id", "hunk").orderBy("pos")
    before = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    number = lambda group: F.first(F.regexp_extract("raw", HUNK, group)).over(in_hunk)
    count = lambda group: F.when(number(group) == "", 1).otherwise(number(group).try_cast("int"))
    first = F.substring("raw", 1, 1)
    is_old = (first.isin(" ", "-") | (raw == "")) & ~header
    is_new = (first.isin(" ", "+") | (raw == "")) & ~header
    counted = (
        hunked.withColumn("old_start", number(1).try_cast("int"))
        .withColumn("old_count", count(2))
        .withColumn("new_start", number(3).try_cast("int"))
        .withColumn("new_count", count(4))
        .withColumn("olds", F.coalesce(F.sum(is_old.cast("int")).over(before), F.lit(0)).cast("int"))
        .withColumn("news", F.coalesce(F.sum(is_new.cast("int")).over(before), F.lit(0)).cast("int"))
    )
    inside = (F.col("hunk") > 0) & ((F.col("olds") < F.col("old_count")) | (F.col("news") < F.col("new_count")))
    kind = (
        F.when(header, "hunk")
        .when(~inside, "outside")
        .when(first == "+", "add")
        .when(first == "-", "remove")
        .when((first == " ") | (raw == ""), "context")
        .when(first == "\\", "note")
        .otherwise("malformed")
    )
    typed = counted.withColumn("kind", kind)
    named = (F.col("kind") == "outside") & (raw.startswith("--- a/") | raw.startswith("+++ b/"))
    filed = typed.withColumn(
        "path", F.last(F.when(named, F.substr("raw", F.lit(7))), ignorenulls=True).over(change)
    ).where(F.col("path").isNotNull() & ~F.col("kind").isin("outside", "note"))
    is_hunk = F.col("kind") == "hunk"
    return filed.select(
        "change_id",
        "path",
        "pos",
        "hunk",
        "kind",
        F.when(is_hunk, raw).otherwise(F.substr("raw", F.lit(2))).alias("text"),
        F.when(F.col("kind").isin("context", "remove"), F.col("old_start") + F.col("olds")).alias("left_line"),
        F.when(F.col("kind").isin("context", "add"), F.col("new_start") + F.col("news")).alias("right_line"),
        # Old line the row stands before; an empty old range names the line after which it adds.
        (F.col("old_start") + F.col("olds") + F.when(F.col("old_count") == 0, 1).otherwise(0)).alias("old_cursor"),
        F.when(is_hunk, F.col("old_start")).alias("old_start"),
        F.when(is_hunk, F.col("old_count")).alias("old_count"),
        F.when(is_hunk, F.col("new_count")).alias("new_count"),
    )


def unsound_hunks(lines: DataFrame) -> DataFrame:
    """(change_id, path, malformed, overlapping) of the files of diff lines.

    Malformed: a line that is no diff content, or a hunk with fewer lines than its header says.
    Overlapping: a hunk that begins before the one above it has ended in the old text.
    """
    hunks = lines.groupBy(*KEYS, "hunk").agg(
        F.max("old_start").alias("start"), F.max("old_count").alias("old_count"), F.max("new_count").alias("new_count"),
        F.count_if(F.col("kind").isin("context", "remove")).alias("olds"),
        F.count_if(F.col("kind").isin("context", "add")).alias("news"),
        F.bool_or(F.col("kind") == "malformed").alias("odd"),
    )
    above = F.lag(F.col("start") + F.col("old_count")).over(Window.partitionBy(*KEYS).orderBy("hunk"))
    judged = hunks.withColumn("_above", above)
    short = (F.col("olds") < F.col("old_count")) | (F.col("news") < F.col("new_count"))
    return judged.groupBy(*KEYS).agg(
        F.bool_or(F.col("odd") | short).alias("malformed"),
        F.bool_or(F.coalesce(F.col("start") < F.col("_above"), F.lit(False))).alias("overlapping"),
    )


def diff_stats(lines: DataFrame) -> DataFrame:
    """Added and removed lines per change and file."""
    return lines.groupBy(*KEYS).agg(
        F.count_if(F.col("kind") == "add").alias("added"),
        F.count_if(F.col("kind") == "remove").alias("removed"),
    )


def verify_diff(pairs: DataFrame, limits: EditLimits = EDITS) -> DataFrame:
    """Re-applies each diff to its original and compares with the updated text.

    ``pairs`` has change_id, path, original, updated, diff. Verdicts: verified, no_change,
    too_large, invisible, malformed, overlapping, context_mismatch, not_reproduced. The diff is re-read line by line
    here, independently of how it was rendered.
    """
    rows = diff_lines(pairs.select("change_id", "diff"))
    unsound = unsound_hunks(rows)
    packed = rows.where("kind in ('add', 'remove', 'context')").groupBy(*KEYS).agg(
        F.collect_list(F.struct("kind", "left_line", "right_line", "old_cursor", "text")).alias("_rows")
    )
    empty = F.array().cast(
        "array<struct<kind:string,left_line:int,right_line:int,old_cursor:int,text:string>>"
    )
    joined = (
        pairs.join(packed, KEYS, "left")
        .join(unsound, KEYS, "left")
        .withColumn("_rows", F.coalesce("_rows", empty))
        .withColumn("_old", file_lines(F.col("original")))
        .withColumn("_new", file_lines(F.col("updated")))
    )
    wrong = F.exists(
        "_rows",
        lambda r: (r["kind"] != "add")
        & ~F.coalesce(F.try_element_at(F.col("_old"), r["left_line"]) == r["text"], F.lit(False)),
    )
    removed = F.transform(F.filter("_rows", lambda r: r["kind"] == "remove"), lambda r: r["left_line"])
    kept = F.filter(
        F.transform(
            "_old",
            lambda line, i: F.struct(
                (i + 1).alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("right_line"), line.alias("text")
            ),
        ),
        lambda line: ~F.array_contains(removed, line["at"]),
    )
    added = F.transform(
        F.filter("_rows", lambda r: r["kind"] == "add"),
        lambda r: F.struct(
            r["old_cursor"].alias("at"), F.lit(0).alias("turn"), r["right_line"].alias("right_line"), r["text"].alias("text")
        ),
    )
    rebuilt = F.transform(F.array_sort(F.concat(kept, added)), lambda line: line["text"])
    verdict = (
        F.when(F.col("original") == F.col("updated"), "no_change")
        .when(F.octet_length("updated") > limits.max_patched_bytes, "too_large")
        .when(F.col("diff") == "", "invisible")
        .when(F.coalesce("malformed", F.lit(False)), "malformed")
        .when(F.coalesce("overlapping", F.lit(False)), "overlapping")
        .when(wrong, "context_mismatch")
        .when(rebuilt != F.col("_new"), "not_reproduced")
        .otherwise("verified")
    )
    return joined.withColumn("verdict", verdict).drop("_rows", "_old", "_new", "malformed", "overlapping")
