"""Lookups over the index for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import secrets, text
from textquarry.functions.paths import is_env_file

MAX_READ_LINES = 400
EXCERPT_CHARS = 700
GRAM = 3


def symbol_label() -> Column:
    """Symbol and parent of a chunk in one text, empty without them."""
    return F.concat_ws("\x00", F.lower("symbol"), F.lower("parent_symbol"))


def symbol_pieces(name: Column) -> Column:
    """Every piece of a name of one to three letters, each once."""

    def pieces(size: int) -> Column:
        starts = F.when(
            F.length(name) >= size, F.sequence(F.lit(1), F.length(name) - (size - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(name, i, F.lit(size)))

    return F.array_distinct(F.concat(*(pieces(size) for size in range(1, GRAM + 1))))


def find_symbol(names: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks whose symbol or parent contains a name, exact first, then shorter ones.

    ``names`` has request_id, repository_id and name. A substring match is found over the
    distinct symbols of a repository: each symbol is filed under its pieces of up to three
    letters, a name is looked up under its own first piece, and the match itself is verified.
    """
    wanted = names.select(
        "request_id", "repository_id", F.lower(F.trim("name")).alias("_name")
    ).where("_name <> ''")
    keyed = chunks.withColumn("_label", symbol_label()).where("_label <> ''")
    labels = keyed.select("repository_id", "_label").distinct()
    filed = labels.select("repository_id", "_label", F.explode(symbol_pieces(F.col("_label"))).alias("_gram"))
    hits = (
        filed.join(
            wanted.withColumn("_gram", F.substring("_name", 1, GRAM)), ["repository_id", "_gram"]
        )
        .where(F.contains("_label", "_name"))
        .drop("_gram")
    )
    order = Window.partitionBy("request_id").orderBy(
        F.desc((F.coalesce(F.lower("symbol"), F.lit("")) == F.col("_name")).cast("int")),
        F.length(F.coalesce("symbol", F.lit(""))),
        "path",
        "start_line",
        "chunk_id",
    )
    return (
        keyed.join(hits, ["repository_id", "_label"])
        .withColumn("match_rank", F.row_number().over(order))
        .where(F.col("match_rank") <= limit)
        .withColumn("excerpt", text.cut_at_newline(secrets.redact(F.col("content")), EXCERPT_CHARS))
        .drop("_label", "_name")
    )


def excerpt(df: DataFrame, chars: int = EXCERPT_CHARS) -> DataFrame:
    """Adds a redacted excerpt and whether it was cut."""
    clean = secrets.redact(F.col("content"))
    return df.withColumn("excerpt", text.cut_at_newline(clean, chars)).withColumn(
        "content_truncated", F.length(clean) > chars
    )


def file_lines(content: Column) -> Column:
    """Lines without their breaks; a final break starts no further line."""
    lines = F.split(content, text.LINE_BREAK)
    last_empty = F.element_at(lines, -1) == ""
    return F.when(last_empty, F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def read_ranges(
    requests: DataFrame, files: DataFrame, max_lines: int = MAX_READ_LINES, max_chars: int = 20_000
) -> DataFrame:
    """Bounded line ranges of files: clamped, capped by lines and by whole-line characters.

    ``requests`` has request_id, repository_id, path, start_line and end_line (may be null).
    A missing file or an environment file gives an error row.
    """
    held = files.select("repository_id", "path", file_lines(F.col("content")).alias("_lines"))
    total = F.size("_lines")
    start = F.greatest(F.lit(1), F.least(F.coalesce("start_line", F.lit(1)), F.greatest(total, F.lit(1))))
    asked_end = F.greatest(F.col("_start"), F.least(F.coalesce("end_line", total), total))
    capped = F.least(asked_end, F.col("_start") + (max_lines - 1), total)
    joined = (
        requests.join(held, ["repository_id", "path"], "left")
        .withColumn(
            "error",
            F.when(is_env_file(F.col("path")), "environment files are not readable").when(
                F.col("_lines").isNull(), "no indexed file at this path"
            ),
        )
        .withColumn("_lines", F.when(F.col("error").isNull(), F.col("_lines")))
        .withColumn("_start", start)
        .withColumn("_capped", capped)
    )
    window = F.slice("_lines", F.col("_start"), F.greatest(F.col("_capped") - F.col("_start") + 1, F.lit(0)))
    begin = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("taken"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        chars = acc["chars"] + F.length(line) + 1
        full = acc["full"] | ((chars > max_chars) & (acc["taken"] > 0))
        return F.struct(
            F.when(full, acc["chars"]).otherwise(chars).alias("chars"),
            F.when(full, acc["taken"]).otherwise(acc["taken"] + 1).alias("taken"),
            full.alias("full"),
        )

    sized = joined.withColumn("_window", window).withColumn(
        "_taken", F.aggregate("_window", begin, step, lambda acc: acc["taken"])
    )
    body = F.array_join(F.slice("_window", F.lit(1), F.col("_taken")), "\n")
    last = F.when(total > 0, F.greatest(F.col("_start") + F.col("_taken") - 1, F.col("_start"))).otherwise(0)
    ok = F.col("error").isNull()
    return sized.select(
        "request_id",
        "repository_id",
        "path",
        F.when(ok, F.col("_start")).alias("start_line"),
        F.when(ok, last).alias("end_line"),
        F.when(ok, total).alias("total_lines"),
        F.when(ok, last < total).alias("truncated"),
        F.when(ok, secrets.redact(body)).alias("content"),
        F.when(ok, secrets.redaction_count(body)).alias("redacted_secrets"),
        "error",
    )


def unread_ranges(reads: DataFrame, totals: DataFrame) -> DataFrame:
    """Line ranges of a file that no read of an investigation has covered.

    ``reads`` has investigation_id, path, start_line, end_line; ``totals`` investigation_id,
    path, total_lines. Identical reads are merged first; the reads of one file in one
    investigation are few.
    """
    keys = ["investigation_id", "path"]
    distinct = reads.groupBy(*keys, "start_line").agg(F.max("end_line").alias("end_line"))
    order = Window.partitionBy(*keys).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    before = distinct.withColumn(
        "_cursor", F.coalesce(F.max("end_line").over(order) + 1, F.lit(1))
    ).where(F.col("start_line") > F.col("_cursor"))
    inner = before.select(*keys, F.col("_cursor").alias("unread_start"), (F.col("start_line") - 1).alias("unread_end"))
    reached = distinct.groupBy(*keys).agg(F.max("end_line").alias("_end"))
    tail = (
        totals.join(reached, keys, "left")
        .withColumn("unread_start", F.coalesce(F.col("_end") + 1, F.lit(1)))
        .where(F.col("unread_start") <= F.col("total_lines"))
        .select(*keys, "unread_start", F.col("total_lines").alias("unread_end"))
    )
    return inner.unionByName(tail)


def register_evidence(spans: DataFrame, block: int = 65_536) -> DataFrame:
    """Stable label per investigation and span by first appearance.

    ``spans`` has investigation_id, seq, path, start_line, end_line, symbol, origin. Repeats of a
    span collapse map-side. Labels are numbered within blocks of ``seq`` and shifted by the size
    of the earlier blocks, so a huge investigation is numbered by many tasks.
    """
    keys = ["investigation_id", "path", "start_line", "end_line"]
    first = (
        spans.groupBy(*keys)
        .agg(
            F.min("seq").alias("first_seq"),
            F.min_by("symbol", "seq").alias("symbol"),
            F.min_by("origin", "seq").alias("origin"),
        )
        .withColumn("_block", F.floor(F.col("first_seq") / block))
    )
    in_block = Window.partitionBy("investigation_id", "_block").orderBy("first_seq", "path", "start_line", "end_line")
    earlier = (
        Window.partitionBy("investigation_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        first.groupBy("investigation_id", "_block")
        .agg(F.count("*").alias("_size"))
        .withColumn("_shift", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    number = F.row_number().over(in_block) + F.col("_shift")
    return (
        first.join(shifts, ["investigation_id", "_block"])
        .withColumn("label", F.concat(F.lit("S"), number.cast("string")))
        .select("label", *keys, "symbol", "origin", "first_seq")
    )


def tool_activity_summary(calls: DataFrame) -> DataFrame:
    """Calls, failures and time per investigation and tool."""
    return calls.groupBy("investigation_id", "tool").agg(
        F.count("*").alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.sum("duration_ms").alias("total_ms"),
    )


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files per repository and language, most first."""
    counted = (
        files.where(F.col("language").isNotNull())
        .groupBy("repository_id", "language")
        .agg(F.count("*").alias("files"))
    )
    order = Window.partitionBy("repository_id").orderBy(F.desc("files"), "language")  # <= 22 rows
    return counted.withColumn("position", F.row_number().over(order))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order, each row with the total count.

    Ordered limit keeps limit + offset rows per task; nothing is sorted globally.
    """
    total = df.agg(F.count("*").alias("total_rows"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    # One row: the count. Joined on a constant, so this is a one-row broadcast, not a product.
    return rows.withColumn("_one", F.lit(1)).join(
        F.broadcast(total.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


def match_full_name(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose owner and name equal a wanted pair, ignoring case."""
    keys = wanted.select(F.lower("owner").alias("_owner"), F.lower("name").alias("_name")).distinct()
    return (
        df.withColumn("_owner", F.lower("owner"))
        .withColumn("_name", F.lower("name"))
        .join(keys, ["_owner", "_name"], "left_semi")
        .drop("_owner", "_name")
    )
