"""Chunking of files into exact, line-aligned byte ranges.

A file is one row of at most ``max_file_bytes``, so everything here is narrow: spans, gaps and
windows are array columns folded in place, and no content is shuffled to cut it into chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import scan, text
from textquarry.settings import INDEX, IndexLimits

SPAN = "struct<start:int,end:int,kind:string,node_type:string,name:string,parent:string>"
RANGES = "array<struct<start:int,end:int>>"
ITEM = (
    "struct<start:int,end:int,chunk_type:string,node_type:string,symbol:string,"
    "parent_symbol:string,part_index:int,part_count:int,gap:boolean>"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a nested expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- line windows ------------------------------------------------------------


def line_windows(data: Column, start: Column, end: Column, limits: IndexLimits) -> Column:
    """Ranges of whole lines: a window closes after the line that reaches a limit.

    The line limit counts lines; the size limit counts bytes, so a window may exceed it by one
    line.
    """
    lines = text.split_lines_keep_ends(text.byte_slice(data, start, end))
    begin = F.struct(
        F.array().cast(RANGES).alias("windows"),
        start.cast("int").alias("first"),
        start.cast("int").alias("cursor"),
        F.lit(0).alias("lines"),
    )

    def step(acc: Column, line: Column) -> Column:
        reached = acc["cursor"] + F.octet_length(line)
        full = (acc["lines"] + 1 >= limits.max_chunk_lines) | (
            reached - acc["first"] >= limits.max_chunk_chars
        )
        return F.struct(
            F.when(
                full,
                F.array_append(
                    acc["windows"], F.struct(acc["first"].alias("start"), reached.alias("end"))
                ),
            ).otherwise(acc["windows"]).alias("windows"),
            F.when(full, reached).otherwise(acc["first"]).alias("first"),
            reached.alias("cursor"),
            F.when(full, F.lit(0)).otherwise(acc["lines"] + 1).alias("lines"),
        )

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["first"].alias("start"), acc["cursor"].alias("end"))
        return F.when(
            acc["first"] < acc["cursor"], F.array_append(acc["windows"], rest)
        ).otherwise(acc["windows"])

    return F.aggregate(lines, begin, step, finish)


# ---- spans -------------------------------------------------------------------

def spans_by_pattern(files: DataFrame, rules: dict[str, tuple[scan.SpanRule, ...]] | None = None) -> DataFrame:
    """Adds ``spans``: declarations found by one pass over the tokens of each file.

    Covers Python and the JavaScript family; languages named in ``rules`` get the blocks of their
    rules (``scan.MARKDOWN``, ``scan.HTML``), others an empty array. Decorators, `export` and a
    binding that holds one declarator belong to their declaration, and a function directly inside a
    class is a method. Functions and classes that have no name are not isolated, unless exported.
    Text in strings, comments, template literals and JSX declares nothing. Any other producer may
    supply the same column instead.
    """
    known = rules or {}

    @F.arrow_udf(f"array<{SPAN}>")
    def find(content: pa.Array, language: pa.Array) -> pa.Array:
        rows = [
            [(s.start, s.end, s.kind, s.node_type, s.name, s.parent) for s in scan.find_spans(text, name, known)]
            for text, name in zip(content.to_pylist(), language.to_pylist())
        ]
        fields = ("start", "end", "kind", "node_type", "name", "parent")
        kinds = (pa.int32(), pa.int32(), *[pa.string()] * 4)
        named = [[dict(zip(fields, span)) for span in spans] for spans in rows]
        return pa.array(named, pa.list_(pa.struct(list(zip(fields, kinds)))))

    structured = F.col("language").isin(*text.COMMENT_PREFIXES, *known)
    return files.withColumn("spans", F.when(structured, find(F.when(structured, F.col("content")), F.col("language"))).otherwise(F.array().cast(f"array<{SPAN}>")))


def collect_spans(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Attach a table of spans to its files as one source-ordered array per file.

    The spans of one file are bounded by the file size limit. ``spans`` has repository_id, path
    and the fields of the span struct.
    """
    packed = spans.groupBy("repository_id", "path").agg(
        F.array_sort(
            F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "end", "kind", "node_type", "name", "parent"))
        ).alias("_packed")
    )
    ordered = F.transform(
        F.coalesce(F.col("_packed"), F.array()),
        lambda span: F.struct(
            span["start"].cast("int").alias("start"),
            span["end"].cast("int").alias("end"),
            span["kind"].alias("kind"),
            span["node_type"].alias("node_type"),
            span["name"].alias("name"),
            span["parent"].alias("parent"),
        ),
    )
    return (
        files.join(packed, ["repository_id", "path"], "left")
        .withColumn("spans", ordered.cast(f"array<{SPAN}>"))
        .drop("_packed")
    )


def ancestor_chains(spans: Column) -> Column:
    """For each span the indexes of the spans around it, outermost first.

    A span leaves the stack only when it ends at or before the start of the next one, so two
    spans that merely overlap count as parent and child.
    """
    begin = F.struct(
        F.array().cast("array<int>").alias("stack"),
        F.array().cast("array<array<int>>").alias("chains"),
    )

    def step(acc: Column, i: Column) -> Column:
        here = F.element_at(spans, i + 1)
        depth = F.array_max(
            F.transform(
                acc["stack"],
                lambda s, k: F.when(F.element_at(spans, s + 1)["end"] > here["start"], k + 1).otherwise(0),
            )
        )
        around = F.slice(acc["stack"], F.lit(1), F.coalesce(depth, F.lit(0)))
        return let(
            around,
            lambda chain: F.struct(
                F.array_append(chain, i).alias("stack"),
                F.array_append(acc["chains"], chain).alias("chains"),
            ),
        )

    indexes = F.when(
        F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indexes, begin, step, lambda acc: acc["chains"])


def span_tree(files: DataFrame) -> DataFrame:
    """One row per span with its index, its parent's index and its depth."""
    chained = files.select(
        "repository_id", "path", F.col("spans"), ancestor_chains(F.col("spans")).alias("_chains")
    )
    zipped = chained.select(
        "repository_id", "path", F.posexplode(F.arrays_zip("spans", "_chains")).alias("span_index", "_s")
    )
    return zipped.select(
        "repository_id",
        "path",
        "span_index",
        F.col("_s.spans.start").alias("start_byte"),
        F.col("_s.spans.end").alias("end_byte"),
        F.col("_s.spans.name").alias("symbol"),
        F.try_element_at(F.col("_s._chains"), F.lit(-1)).alias("parent_index"),
        F.size(F.col("_s._chains")).alias("depth"),
    )


def _nodes(files: DataFrame, limits: IndexLimits) -> DataFrame:
    """Adds ``_nodes``: spans that are emitted, split or descended into, in source order.

    Every array is bound by ``let``: the planner would else put its expression in place of its name,
    also within functions of elements, which then compute the whole array for each element.
    """

    def nodes(spans: Column, data: Column, chains: Column, fits: Column) -> Column:
        def node(span: Column, i: Column) -> Column:
            chain = F.element_at(chains, i + 1)
            # In source order the first child of a span follows it.
            following = F.try_element_at(F.coalesce(F.try_element_at(chains, i + 2), F.array().cast("array<int>")), F.lit(-1))
            return F.struct(
                i.alias("index"),
                span.alias("span"),
                F.coalesce(F.try_element_at(chain, F.lit(-1)), F.lit(-1)).alias("scope"),
                F.element_at(fits, i + 1).alias("fits"),
                F.coalesce(following == i, F.lit(False)).alias("has_children"),
                F.exists(chain, lambda a: F.element_at(fits, a + 1)).alias("covered"),
            )

        return F.filter(F.transform(spans, node), lambda n: ~n["covered"])

    def sized(spans: Column, data: Column) -> Column:
        fits = F.transform(spans, lambda s: F.length(text.byte_slice(data, s["start"], s["end"])) <= limits.max_chunk_chars)
        return let(ancestor_chains(spans), lambda chains: let(fits, lambda f: nodes(spans, data, chains, f)))

    found = let(F.struct(F.col("spans").alias("spans"), F.col("_data").alias("data")), lambda v: let(v["spans"], lambda spans: sized(spans, v["data"])))
    return files.withColumn("_data", text.utf8(F.col("content"))).withColumn("_nodes", found)


def _item(start, end, kind, node_type, symbol, parent, part, parts, gap) -> Column:
    values = (start, end, kind, node_type, symbol, parent, part, parts, gap)
    names = (
        "start", "end", "chunk_type", "node_type", "symbol", "parent_symbol", "part_index",
        "part_count", "gap",
    )
    return F.struct(*(v.alias(n) for v, n in zip(values, names))).cast(ITEM)


def _symbol_items(limits: IndexLimits) -> Column:
    """Chunk items of every emitted span: one when it fits, line windows when it does not."""

    def parts(node: Column, data: Column) -> Column:
        span = node["span"]
        whole = F.array(F.struct(span["start"].alias("start"), span["end"].alias("end")))
        ranges = F.when(node["fits"], whole).otherwise(
            line_windows(data, span["start"], span["end"], limits)
        )
        kept = F.filter(
            ranges, lambda r: ~text.is_blank(text.byte_slice(data, r["start"], r["end"]))
        )
        return let(
            kept,
            lambda rs: F.transform(
                rs,
                lambda r, i: _item(
                    r["start"], r["end"], span["kind"], span["node_type"], span["name"],
                    span["parent"], i + 1, F.size(rs), F.lit(False),
                ),
            ),
        )

    leaves = F.filter("_nodes", lambda n: n["fits"] | ~n["has_children"])
    return let(F.col("_data"), lambda data: F.flatten(F.transform(leaves, lambda node: parts(node, data))))


def _gap_items() -> Column:
    """Ranges no span claims, with the enclosing symbol (null at top level)."""
    return let(F.struct(F.col("_nodes").alias("nodes"), F.octet_length("_data").alias("size")), lambda v: let(v["nodes"], lambda nodes: _gaps_of(nodes, v["size"])))


def _gaps_of(nodes: Column, size: Column) -> Column:

    def gap(start: Column, end: Column, symbol: Column) -> Column:
        kind = F.when(symbol.isNull(), "module").otherwise("block")
        none = F.lit(None).cast("string")
        return _item(start, end, kind, none, symbol, none, F.lit(1), F.lit(1), F.lit(True))

    def scope_start(scope: Column) -> Column:
        around = F.filter(nodes, lambda n: n["index"] == scope)
        return F.coalesce(F.try_element_at(around, F.lit(1))["span"]["start"], F.lit(0))

    def scope_name(scope: Column) -> Column:
        around = F.filter(nodes, lambda n: n["index"] == scope)
        return F.try_element_at(around, F.lit(1))["span"]["name"]

    def reached(scope: Column, before: Column) -> Column:
        earlier = F.filter(nodes, lambda n: (n["scope"] == scope) & (n["index"] < before))
        ends = F.array_max(F.transform(earlier, lambda n: n["span"]["end"]))
        return F.greatest(scope_start(scope), F.coalesce(ends, F.lit(0)))

    def ahead(node: Column) -> Column:
        return gap(
            reached(node["scope"], node["index"]), node["span"]["start"], scope_name(node["scope"])
        )

    def behind(node: Column) -> Column:
        return gap(
            reached(node["index"], F.lit(2_147_483_647)), node["span"]["end"], node["span"]["name"]
        )

    opened = F.filter(nodes, lambda n: ~n["fits"] & n["has_children"])
    tail = gap(
        reached(F.lit(-1), F.lit(2_147_483_647)),
        size,
        F.lit(None).cast("string"),
    )
    every = F.concat(F.transform(nodes, ahead), F.transform(opened, behind), F.array(tail))
    return F.filter(every, lambda g: g["end"] > g["start"])


def emit_symbols(files: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Adds ``_items``: the largest spans that fit, oversized leaves cut into line windows."""
    return _nodes(files, limits).withColumn("_items", _symbol_items(limits))


def gaps(files: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """One row per uncovered range between emitted spans."""
    found = _nodes(files, limits).select(
        "repository_id", "path", F.explode(_gap_items()).alias("g")
    )
    return found.select(
        "repository_id",
        "path",
        F.col("g.start").alias("start_byte"),
        F.col("g.end").alias("end_byte"),
        F.col("g.chunk_type").alias("chunk_type"),
        F.col("g.symbol").alias("scope_symbol"),
    )


# ---- gap trivia --------------------------------------------------------------


def _gap_lines(start: Column, end: Column) -> Column:
    """Lines of a gap as (start, end, kind)."""
    data = F.col("_data")
    begin = F.struct(
        F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("lines"),
        start.cast("int").alias("cursor"),
    )

    def step(acc: Column, line: Column) -> Column:
        stop = acc["cursor"] + F.octet_length(line)
        row = F.struct(
            acc["cursor"].alias("start"),
            stop.alias("end"),
            text.line_kind(line, F.col("language")).alias("kind"),
        )
        return F.struct(F.array_append(acc["lines"], row).alias("lines"), stop.alias("cursor"))

    return F.aggregate(
        text.split_lines_keep_ends(text.byte_slice(data, start, end)), begin, step,
        lambda acc: acc["lines"],
    )


def _gap_edges(item: Column) -> Column:
    """(lead_end, trail_start) of a gap: closing punctuation in front, heading comment behind."""
    data = F.col("_data")
    mid_line = (item["start"] > 0) & (
        F.substring(data, item["start"], F.lit(1)) != F.lit(b"\n")
    )

    def edges(lines: Column) -> Column:
        numbered = F.transform(
            lines,
            lambda line, i: F.struct(
                line["start"].alias("start"), line["end"].alias("end"), line["kind"].alias("kind"),
                (mid_line & (i == 0)).alias("tail"),
            ),
        )

        def forward(acc: Column, line: Column) -> Column:
            taken = F.when(line["tail"], line["kind"].isin("comment", "punctuation")).otherwise(
                line["kind"] == "punctuation"
            )
            stop = F.when(line["tail"], line["kind"] == "code").otherwise(
                ~line["kind"].isin("punctuation", "blank")
            )
            return F.struct(
                F.when(~acc["stopped"] & taken, line["end"]).otherwise(acc["edge"]).alias("edge"),
                (acc["stopped"] | stop).alias("stopped"),
            )

        lead = F.aggregate(
            numbered, F.struct(item["start"].alias("edge"), F.lit(False).alias("stopped")), forward,
            lambda acc: acc["edge"],
        )

        def with_lead(lead_end: Column) -> Column:
            def backward(acc: Column, line: Column) -> Column:
                stop = (
                    line["tail"]
                    | (line["start"] < lead_end)
                    | ~line["kind"].isin("comment", "blank")
                )
                return F.struct(
                    F.when(~acc["stopped"] & ~stop & (line["kind"] == "comment"), line["start"])
                    .otherwise(acc["edge"]).alias("edge"),
                    (acc["stopped"] | stop).alias("stopped"),
                )

            trail = F.aggregate(
                F.reverse(numbered),
                F.struct(item["end"].alias("edge"), F.lit(False).alias("stopped")),
                backward,
                lambda acc: acc["edge"],
            )
            return F.struct(lead_end.alias("lead_end"), trail.alias("trail_start"))

        return let(lead, with_lead)

    return let(_gap_lines(item["start"], item["end"]), edges)


def attach_gap_trivia(limits: IndexLimits) -> Column:
    """Fold over source-ordered ``_items``: trivia joins its neighbour, the rest becomes chunks.

    Leading punctuation goes to the chunk that ends where the gap begins; a comment block goes
    to the chunk that begins where the gap ends; with nothing to introduce it closes the
    previous chunk. No attachment may exceed the size limit.
    """
    data = F.col("_data")
    no_item = F.lit(None).cast(ITEM)

    def chars(start: Column, end: Column) -> Column:
        return F.length(text.byte_slice(data, start, end))

    def moved(item: Column, start: Column, end: Column) -> Column:
        return _item(
            start, end, item["chunk_type"], item["node_type"], item["symbol"],
            item["parent_symbol"], item["part_index"], item["part_count"], F.lit(False),
        )

    def pair(item: Column, i: Column) -> Column:
        edges = F.when(item["gap"], _gap_edges(item))
        return F.struct(
            item.alias("item"),
            F.coalesce(F.try_element_at(F.col("_items"), i + 2), no_item).alias("next"),
            edges["lead_end"].alias("lead_end"),
            edges["trail_start"].alias("trail_start"),
        )

    def middle_chunks(gap: Column, start: Column, end: Column) -> Column:
        windows = F.filter(
            line_windows(data, start, end, limits),
            lambda w: text.has_alnum(text.byte_slice(data, w["start"], w["end"])),
        )
        made = F.transform(windows, lambda w: moved(gap, w["start"], w["end"]))
        return F.when(
            (end > start) & text.has_alnum(text.byte_slice(data, start, end)), made
        ).otherwise(F.array().cast(f"array<{ITEM}>"))

    def on_gap(acc: Column, p: Column) -> Column:
        gap, following = p["item"], p["next"]
        last = F.try_element_at(acc["done"], F.lit(-1))
        touching = F.coalesce(last["end"] == gap["start"], F.lit(False))
        lead = touching & (p["lead_end"] > gap["start"]) & (
            chars(last["start"], p["lead_end"]) <= limits.max_chunk_chars
        )
        has_trail = p["trail_start"] < gap["end"]
        onward = F.coalesce(
            has_trail
            & ~following["gap"]
            & (following["start"] == gap["end"])
            & (following["part_index"] == 1)
            & (chars(p["trail_start"], following["end"]) <= limits.max_chunk_chars),
            F.lit(False),
        )
        start = F.when(lead, p["lead_end"]).otherwise(gap["start"])

        def settle(s: Column) -> Column:
            closes = (
                touching
                & has_trail
                & ~s["onward"]
                & ~text.has_alnum(text.byte_slice(data, s["start"], p["trail_start"]))
                & (chars(last["start"], gap["end"]) <= limits.max_chunk_chars)
            )

            def finish(closed: Column) -> Column:
                new_end = F.when(closed, gap["end"]).when(s["lead"], p["lead_end"]).otherwise(last["end"])
                kept = F.when(
                    closed | s["lead"],
                    F.array_append(
                        F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1),
                        moved(last, last["start"], new_end),
                    ),
                ).otherwise(acc["done"])
                m_start = F.when(closed, gap["end"]).otherwise(s["start"])
                m_end = F.when(s["onward"], p["trail_start"]).otherwise(gap["end"])
                return F.struct(
                    F.concat(kept, middle_chunks(gap, m_start, m_end)).alias("done"),
                    F.when(s["onward"], p["trail_start"]).otherwise(F.lit(-1)).alias("pulled"),
                )

            return let(closes, finish)

        return let(
            F.struct(lead.alias("lead"), onward.alias("onward"), start.alias("start")), settle
        )

    def step(acc: Column, p: Column) -> Column:
        item = p["item"]
        begin = F.when(acc["pulled"] >= 0, acc["pulled"]).otherwise(item["start"])
        plain = F.struct(
            F.array_append(acc["done"], moved(item, begin, item["end"])).alias("done"),
            F.lit(-1).alias("pulled"),
        )
        return F.when(item["gap"], on_gap(acc, p)).otherwise(plain)

    begin = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), F.lit(-1).alias("pulled"))
    return F.aggregate(F.transform("_items", pair), begin, step, lambda acc: acc["done"])


# ---- composition -------------------------------------------------------------


def chunk_key(repository: Column, path: Column, start: Column, part: Column) -> Column:
    """Deterministic chunk id: the same range of the same file has the same id in every run."""
    identity = F.concat_ws("|", repository, path, start.cast("string"), part.cast("string"))
    return F.left(F.sha2(identity, 256), F.lit(32))


def _rows(files: DataFrame) -> DataFrame:
    """Explode finished items into chunk rows with lines and content."""
    data = F.col("_data")

    def line_at(offset: Column) -> Column:
        return text.count_char(text.byte_slice(data, F.lit(0), offset), "\n") + 1

    detailed = F.transform(
        "_done",
        lambda c: F.struct(
            c.alias("item"),
            line_at(c["start"]).alias("start_line"),
            line_at(F.greatest(c["start"], c["end"] - 1)).alias("end_line"),
            text.byte_slice(data, c["start"], c["end"]).alias("content"),
        ),
    )
    rows = files.select("repository_id", "path", "language", F.explode(detailed).alias("c"))
    return rows.select(
        chunk_key(
            F.col("repository_id"), F.col("path"), F.col("c.item.start"), F.col("c.item.part_index")
        ).alias("chunk_id"),
        "repository_id",
        "path",
        "language",
        F.col("c.item.chunk_type").alias("chunk_type"),
        F.col("c.item.node_type").alias("node_type"),
        F.col("c.item.symbol").alias("symbol"),
        F.col("c.item.parent_symbol").alias("parent_symbol"),
        F.col("c.start_line").alias("start_line"),
        F.col("c.end_line").alias("end_line"),
        F.col("c.item.start").alias("start_byte"),
        F.col("c.item.end").alias("end_byte"),
        F.col("c.item.part_index").alias("part_index"),
        F.col("c.item.part_count").alias("part_count"),
        F.col("c.content").alias("content"),
    )


def fallback_items(limits: IndexLimits) -> Column:
    """Line windows over a whole file without structure; blank windows are dropped."""
    data = F.col("_data")
    none = F.lit(None).cast("string")
    windows = F.filter(
        line_windows(data, F.lit(0), F.octet_length(data), limits),
        lambda w: ~text.is_blank(text.byte_slice(data, w["start"], w["end"])),
    )
    return F.transform(
        windows,
        lambda w: _item(
            w["start"], w["end"], F.lit("block"), none, none, none, F.lit(1), F.lit(1), F.lit(False)
        ),
    )


def chunk_by_lines(files: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Chunks of unstructured files."""
    prepared = files.withColumn("_data", text.utf8(F.col("content")))
    return _rows(prepared.withColumn("_done", fallback_items(limits)))


def chunk_by_spans(files: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """Chunks of structured files: symbols, attached trivia and the remaining gaps."""
    with_symbols = emit_symbols(files, limits)
    everything = with_symbols.withColumn(
        "_items", F.array_sort(F.concat(F.col("_items"), _gap_items()))
    )
    return _rows(everything.withColumn("_done", attach_gap_trivia(limits)))


def chunk_files(files: DataFrame, limits: IndexLimits = INDEX) -> DataFrame:
    """All files: by spans where there are some, by line windows otherwise.

    Both branches read the same narrow input; nothing is shuffled.
    """
    if "spans" not in files.columns:
        return chunk_by_lines(files, limits)
    structured = F.size("spans") > 0
    return chunk_by_spans(files.where(structured), limits).unionByName(
        chunk_by_lines(files.where(~structured), limits)
    )


def classify_lines(files: DataFrame) -> DataFrame:
    """One row per line with its kind."""
    lines = files.select(
        "repository_id", "path", "language",
        F.posexplode(F.split("content", text.LINE_BREAK)).alias("_pos", "line"),
    )
    return lines.select(
        "repository_id",
        "path",
        (F.col("_pos") + 1).alias("line_number"),
        text.line_kind(F.col("line"), F.col("language")).alias("kind"),
    )


def chunk_integrity(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Violations per file: overlaps, wrong content, wrong lines, meaningful bytes left out."""
    by_file = Window.partitionBy("repository_id", "path")  # chunks of one file: bounded by size
    order = by_file.orderBy("start_byte", "part_index")
    marked = chunks.select(
        "repository_id", "path", "start_byte", "end_byte", "start_line", "end_line",
        F.md5("content").alias("content_md5"),
        F.coalesce(
            F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("covered_to"),
        F.lead("start_byte").over(order).isNull().alias("is_last"),
    )
    packed = marked.groupBy("repository_id", "path").agg(
        F.count_if(F.col("start_byte") < F.col("covered_to")).alias("overlaps"),
        F.collect_list(
            F.struct("start_byte", "end_byte", "start_line", "end_line", "content_md5", "covered_to", "is_last")
        ).alias("parts"),
    )
    data = text.utf8(F.col("content"))

    def wrong(part: Column) -> Column:
        slice_ = text.byte_slice(F.col("_data"), part["start_byte"], part["end_byte"])
        return (F.md5(slice_) != part["content_md5"]).cast("int")

    def wrong_lines(part: Column) -> Column:
        first = text.count_char(text.byte_slice(F.col("_data"), F.lit(0), part["start_byte"]), "\n") + 1
        last = text.count_char(text.byte_slice(F.col("_data"), F.lit(0), part["end_byte"] - 1), "\n") + 1
        return ((first != part["start_line"]) | (last != part["end_line"])).cast("int")

    def uncovered(part: Column) -> Column:
        ahead = text.byte_slice(F.col("_data"), part["covered_to"], part["start_byte"])
        behind = text.byte_slice(F.col("_data"), part["end_byte"], F.octet_length(F.col("_data")))
        return (
            ((part["start_byte"] > part["covered_to"]) & text.has_alnum(ahead))
            | (part["is_last"] & text.has_alnum(behind))
        ).cast("int")

    def total(flag) -> Column:
        return F.aggregate(F.transform("parts", flag), F.lit(0), lambda acc, v: acc + v)

    return (
        files.select("repository_id", "path", data.alias("_data"))
        .join(packed, ["repository_id", "path"])
        .select(
            "repository_id",
            "path",
            F.size("parts").alias("chunks"),
            F.col("overlaps"),
            total(wrong).alias("wrong_content"),
            total(wrong_lines).alias("wrong_lines"),
            total(uncovered).alias("uncovered"),
        )
    )
