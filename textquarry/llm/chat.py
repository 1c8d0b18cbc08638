"""Chat formatting: reply trees become conversations, one per chosen root-to-leaf path.

`reply_paths` doubles ancestor jumps in self-joins, so a path of n messages takes log2(n) joins.
`format_paths` renders each path with a template whose markers all begin with `<`; texts and
roles are escaped so that neither `<` nor `[` survives in them, which makes the format reversible.

Defined results: null text and null role are empty; a message whose parent is missing is a root;
messages on a cycle have no root and belong to no path; repeated (tree_id, message_id) pairs are
not allowed by the caller's key; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

#: Replaced in this order when escaping and in the opposite order when reading back.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
TURN_END = "<|end|>\n"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def reply_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Rows (tree_id, path_id, rank, position, message_id) of the chosen root-to-leaf paths.

    `messages`: tree_id, message_id, parent_id, score. A branch scores the mean of its messages'
    scores (null: 0); ranks break ties by the smaller leaf. `best` keeps that many branches of
    each tree, None keeps all.
    """
    own = messages.select("tree_id", "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = own.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"))
    step = own.join(
        known, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("m")), "left"
    ).select("tree_id", "message_id", F.col("m").alias("up"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("gain"))
    step = cut_lineage(step)
    largest = step.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    finished, open_, jumps = step.filter("up IS NULL"), step.filter("up IS NOT NULL"), []
    while open_.limit(1).count() and 2 ** len(jumps) <= largest:  # what is open after that is on a cycle
        jumps.append(open_)
        reached = finished.unionByName(open_)
        above = reached.select(*(F.col(c).alias(f"_{c}") for c in step.columns))
        met = F.col("tree_id").eqNullSafe(F.col("_tree_id")) & (F.col("up") == F.col("_message_id"))
        step = cut_lineage(
            open_.join(above, met).select(
                "tree_id",
                "message_id",
                F.col("_up").alias("up"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
                (F.col("gain") + F.col("_gain")).alias("gain"),
            )
        )
        finished, open_ = finished.unionByName(step.filter("up IS NULL")), step.filter("up IS NOT NULL")
    leaves = finished
    if jumps:
        parents = jumps[0].select(F.col("tree_id").alias("t"), F.col("up").alias("m")).distinct()
        is_parent = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m"))
        leaves = finished.join(parents, is_parent, "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("gain") / F.col("depth")), "message_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        chosen = chosen.filter(F.col("rank") <= best)
    paths = chosen.select("tree_id", F.col("message_id").alias("path_id"), "rank", "depth", F.col("message_id"), F.lit(0).cast("bigint").alias("back"))
    for power, jump in enumerate(jumps):
        hop = jump.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "up")
        above = paths.join(hop, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m"))).select(
            "tree_id", "path_id", "rank", "depth", F.col("up").alias("message_id"), (F.col("back") + 2**power).alias("back")
        )
        paths = cut_lineage(paths.unionByName(above))
    return paths.select("tree_id", "path_id", "rank", (F.col("depth") - F.col("back")).alias("position"), "message_id")


def format_paths(paths: DataFrame, messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per path: tree_id, path_id, rank, formatted, loss_spans (start, length in code points)."""
    said = messages.select(
        F.col("tree_id").alias("t"),
        F.col("message_id").alias("m"),
        F.coalesce("role", F.lit("")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    turns = (
        paths.join(said, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")))
        .withColumn("head", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")))
        .withColumn("turn_text", F.concat("head", "body", F.lit(TURN_END)))
    )
    before = Window.partitionBy("tree_id", "path_id", "rank").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(F.length("turn_text")).over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.length("head")).cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))
    rows = placed.groupBy("tree_id", "path_id", "rank").agg(
        F.sort_array(
            F.collect_list(F.struct("position", "turn_text", span.alias("span"), (F.col("role") == trained_role).alias("trained")))
        ).alias("turns")
    )
    return rows.select(
        "tree_id",
        "path_id",
        "rank",
        F.concat_ws("", F.col("turns.turn_text")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.trained), lambda t: t.span).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    mark = F.lit("|>\n")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(3), F.instr(p, "|>\n") - 3)).alias("role"),
            unescape(F.substr(p, F.instr(p, "|>\n") + F.length(mark))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(formatted, s.start + 1, s.length)), ""))
