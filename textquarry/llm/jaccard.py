"""N-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its distinct word shingles; equal sets are one node. Two sets x, y with
similarity t have at least o = t / (1 + t) * (|x| + |y|) tokens in common, so in any global order
of the tokens they share one that is among the first |x| - o + 1 of x and the first |y| - o + 1 of
y. A set's prefix holds its tokens for partners of any size, with the largest partner each token
serves: the later the token, the smaller. Each order puts shingles that occur in fewer documents first (by a sketch of fixed size that
counts all of them; it steers cost, not results) and breaks ties by a hash of its own. A pair is a
candidate only if it shares prefix tokens under every order. The shingle sets of candidates are
then compared in full.

Links are wanted for their components, so they are searched in two rounds. First each prefix token
links its nodes to one of them, the one that has the fewest rarer tokens for its size, which joins
groups of near copies to their original without pairing them all. Then all pairs that share
a token and are not yet in one component are candidates: in each token's list the nodes outside
its largest component meet the rest of the list.

A link never leaves its component, so `join_links` and `linked_pairs` find all links by comparing
the sets of each component with one another: its nodes are dealt to blocks by size class and hash,
each two blocks whose sizes can be similar meet in one group, and their sets are compared in full.
Every pair of different sets is counted once, with the rows at both of its nodes.

Defined results: a text without words, or null, has the empty set and links with nothing; fewer
words than a shingle make one shingle; repeated rows and texts are one node; a null doc_id stays
null and is never a component's id unless all its ids are null; an empty table gives an empty
result; extra columns are ignored. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import exchange
from textquarry.llm.components import components
from textquarry.llm.words import give_back, mixed, parts, sequences
from textquarry.session import cut_lineage

SLICES = 64


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted shingle hashes of each row) for runs of rows."""
    for first, _, words in parts(column, lower=True):
        h = words.hashes()
        grams = sequences(h, n)
        sets = []
        for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            else:
                sets.append(sequences(h[a:b], b - a) if b > a else h[:0])
        yield first, sets


def node_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.sum(mixed(tokens), dtype=np.uint64) + np.uint64(len(tokens))
        return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _describe(n: int, bits: int):
    """Each document's set size and node, then the counts of its task's distinct sets by sketch slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint32), set()
        names = ["doc_id", "n_shingles", "node", "slice", "counts"]
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), n):
                nodes = [node_of(s) if len(s) else None for s in sets]
                fresh = []
                for node, tokens in zip(nodes, sets):
                    if node is not None and node not in seen:
                        seen.add(node)
                        fresh.append(tokens)
                if fresh:
                    slots = (np.concatenate(fresh) >> np.uint64(64 - bits)).astype(np.int64)
                    counts += np.bincount(slots, minlength=1 << bits).astype(np.uint32)
                rows = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.nulls(rows, pa.int32()),
                        pa.nulls(rows, pa.binary()),
                    ],
                    names=names,
                )
        if seen:
            blobs = [zlib.compress(part.tobytes(), 1) for part in np.split(counts, SLICES)]
            nulls = [pa.nulls(SLICES, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], names=names)
        give_back()

    return run


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit length of each slot's count, slice by slice; sums are kept for this task's slices only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
            sums[at] = sums[at] + part if at in sums else part
    classes = [np.ceil(np.log2(s.astype(np.float64) + 1)).astype(np.uint8).tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], names=["slice", "classes"])


def frequency_classes(described: DataFrame, bits: int) -> np.ndarray:
    """A class for each sketch slot; 2**bits bytes whatever the input."""
    merged = (
        described.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_merge_slices, "slice int, classes binary")
    )
    found = {row["slice"]: np.frombuffer(row["classes"], np.uint8) for row in merged.collect()}
    return np.concatenate([found.get(i, np.zeros((1 << bits) // SLICES, np.uint8)) for i in range(SLICES)])


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set in the given global order, and their positions; ties share the first's."""
    size = len(tokens)
    length = size - -(-percent * size // 100) + 1
    bits = (len(classes) - 1).bit_length()
    rarity = classes[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    rank = (rarity << np.uint64(58)) | (mixed(tokens ^ np.uint64(order * 0x5851F42D4C957F2D)) >> np.uint64(6))
    if length < size:
        some = rank <= np.partition(rank, length - 1)[length - 1]
        tokens, rank = tokens[some], rank[some]
    return tokens, np.searchsorted(np.sort(rank), rank)


def _emit(n: int, order: int, percent: int, blocks: int, shared, hold: int = 300_000):
    """Rows of (block, prefix tokens, their sets by number, positions, nodes, sizes); a node once per task."""

    def rows(tokens: list[np.ndarray], places: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.repeat(np.arange(len(nodes)), [len(t) for t in tokens])
        by = np.argsort(token)
        token, owner, place = token[by], owner[by], np.concatenate(places)[by].astype(np.uint32)
        node, size = np.array(nodes, np.int64), np.array(sizes, np.uint32)
        edges = exchange.block_edges(token, blocks)
        spans = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])) if y > x]
        own = [np.unique(owner[x:y], return_inverse=True) for _, x, y in spans]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _, _ in spans], pa.int32()),
                exchange.planes([token[x:y] for _, x, y in spans]),
                exchange.planes([i.astype(np.uint32) for _, i in own]),
                exchange.planes([place[x:y] for _, x, y in spans]),
                exchange.binary([node[o] for o, _ in own]),
                exchange.planes([size[o] for o, _ in own]),
            ],
            names=[f.split()[0] for f in EMITTED.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, held = shared.value, set(), 0
        tokens, places, nodes, sizes = [], [], [], []
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), n):
                for s in sets:
                    node = node_of(s) if len(s) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    own, place = prefix(s, classes, order, percent)
                    tokens.append(own)
                    places.append(place)
                    nodes.append(node)
                    sizes.append(len(s))
                    held += len(own)
                if held >= hold:
                    yield rows(tokens, places, nodes, sizes)
                    tokens, places, nodes, sizes, held = [], [], [], [], 0
        if held:
            yield rows(tokens, places, nodes, sizes)
        del tokens, places, nodes, sizes, seen
        give_back()

    return run


EMITTED = "block int, tokens binary, owners binary, places binary, nodes binary, sizes binary"
LISTED = "token bigint, node bigint, size bigint, most bigint, hub bigint"


def _shared(percent: int):
    """The tokens of a block that fit two or more nodes: the nodes, the largest partner they serve, their hub.

    The hub of a list is the node whose token serves the largest partner for its size; it is null
    for the hub itself and for nodes it doesn't fit.
    """

    def run(block: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        for row in block.to_pylist():
            owner, size = exchange.from_planes(row["owners"], np.uint32), exchange.from_planes(row["sizes"], np.uint32)
            columns[0].append(exchange.from_planes(row["tokens"], np.uint64))
            columns[1].append(np.frombuffer(row["nodes"], np.int64)[owner])
            columns[2].append(size[owner].astype(np.int64))
            columns[3].append(exchange.from_planes(row["places"], np.uint32).astype(np.int64))
        token, node, size, place = map(np.concatenate, columns)
        # The token at a place serves partners y with place <= size - least(size + y).
        most = (size - place) * (100 + percent) // percent - size
        by = np.lexsort((node, token))
        token, node, size, most = token[by], node[by], size[by], most[by]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # a node may come from several tasks
        changed = True
        while changed and len(token):
            token, node, size, most = token[keep], node[keep], size[keep], most[keep]
            heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            runs = np.diff(np.append(heads, len(token)))
            least = np.repeat(np.minimum.reduceat(size, heads), runs)
            keep = (most >= least) & np.repeat(runs > 1, runs)
            changed = not keep.all()
            if not keep.any():
                token, node, size, most = token[:0], node[:0], size[:0], most[:0]
        best = np.lexsort((node, -most / np.maximum(size, 1), token))  # the hub comes first in each list
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        hub = np.repeat(best[heads], np.diff(np.append(heads, len(token))))
        alone = (node[hub] == node) | (most < size[hub]) | (most[hub] < size)
        hubs = pa.array(node[hub], mask=alone)
        return pa.table({"token": token.view(np.int64), "node": node, "size": size, "most": most, "hub": hubs})

    return run


def prefix_lists(documents: DataFrame, n: int, order: int, percent: int, blocks: int, classes) -> DataFrame:
    """(token, node, size, most, hub) of the prefix tokens that several nodes share under one order."""
    rows = documents.select("text").mapInArrow(_emit(n, order, percent, blocks, classes), EMITTED)
    return cut_lineage(rows.groupBy("block").applyInArrow(_shared(percent), LISTED))


def small(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table, broadcast in joins if it was counted to hold at most `most` rows of a few numbers."""
    return F.broadcast(table) if table.count() <= most else table


def documents_of(documents: DataFrame, nodes: DataFrame, described: DataFrame) -> DataFrame:
    """The texts of one document for each of the nodes."""
    wanted = cut_lineage(described.join(nodes.distinct(), "node", "left_semi").select(F.col("rep").alias("wanted")).distinct())
    return documents.join(small(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")


def _sets(n: int):
    """The sets of the texts by node; a node once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), n):
                fresh = {node_of(s): s for s in sets if len(s)}
                fresh = {node: s for node, s in fresh.items() if node not in seen}
                seen.update(fresh)
                sets = list(fresh.values())
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                tokens = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                nodes = pa.array(list(fresh), pa.int64())
                yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(offsets, pa.array(tokens))], names=["node", "tokens"])
        give_back()

    return run


def _verified(percent: int, most: int = 1 << 21):
    """The pairs of a group whose sets are similar enough; the smaller set of a pair is looked up in the other."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        names, first = np.unique(sets["node"].to_numpy(), return_index=True)  # a set may come from several tasks
        lists = sets["tokens"].combine_chunks().take(pa.array(first))
        size = lists.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(size) - size
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        width = int(token.max(initial=0)) + 1
        held = np.sort(np.repeat(np.arange(len(names)), size) * width + token)
        a, b = (np.searchsorted(names, pairs[c].to_numpy()) for c in ("a", "b"))
        low, high = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        both, ends, at = np.zeros(len(a), np.int64), np.cumsum(size[low]), 0
        while at < len(a):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            span = size[low[at:until]]
            pair = np.repeat(np.arange(at, until), span)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(span) - span, span)
            wanted = high[pair] * width + token[starts[low[pair]] + within]
            place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            both[at:until] = np.bincount(pair[held[place] == wanted] - at, minlength=until - at)
            at = until
        return pairs.select(["a", "b"]).filter(pa.array(100 * both >= percent * (size[a] + size[b] - both)))

    return run


def similar(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, n: int, percent: int, group_tokens: int = 2_000_000) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough.

    A pair is verified in the group of its nodes' blocks, and a set goes once to each group that has
    a pair of it: that of a hub to as many as there are blocks, whatever the number of its partners.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), "x", "y"), F.struct(F.col("b").alias("node"), "x", "y"))).alias("at")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    tokens = used.join(nodes, "node").agg(F.sum("n")).first()[0] or 0
    blocks = max(16, math.ceil(math.sqrt(tokens / group_tokens)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pairs = pairs.withColumn("x", block("a")).withColumn("y", block("b"))
    needed = cut_lineage(pairs.select(both).select("at.*").distinct())
    sets = documents_of(documents, used, nodes).select("text").mapInArrow(_sets(n), "node bigint, tokens array<bigint>")
    sent = sets.join(small(needed), "node").select("node", "tokens", F.col("x").alias("sx"), F.col("y").alias("sy"))
    met = pairs.groupBy("x", "y").cogroup(sent.groupBy("sx", "sy"))
    return cut_lineage(met.applyInArrow(_verified(percent), "a bigint, b bigint").distinct())


def _fit(x: str, y: str):
    """Two entries of a token's list serve each other's size."""
    return (F.col(f"{x}.most") >= F.col(f"{y}.size")) & (F.col(f"{y}.most") >= F.col(f"{x}.size"))


def _pair(x: str, y: str) -> list:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs of each node with the hubs of its tokens."""
    met = lists.filter("hub IS NOT NULL")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _crossing(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that share a token and are not in one component, each once; `labels` is a written table."""
    known = lists.drop("hub").join(small(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = cut_lineage(ends.filter("low < high").select("token"))
    mixed_lists = cut_lineage(known.join(small(several), "token", "left_semi"))
    counted = mixed_lists.groupBy("token", "component").agg(F.count("*").alias("members"))
    largest = counted.groupBy("token").agg(F.max(F.struct("members", "component")).alias("largest"))
    mixed_lists = cut_lineage(mixed_lists.join(largest.select("token", F.col("largest.component").alias("largest")), "token"))
    minor = mixed_lists.filter("component <> largest")
    apart = (F.col("x.component") != F.col("y.component")) & (
        (F.col("y.component") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    )
    met = minor.alias("x").join(mixed_lists.alias("y"), "token").filter(apart & _fit("x", "y"))
    return met.select(*_pair("x", "y")).distinct()


def _search(documents: DataFrame, n: int, percent: int, orders: int, bits: int, block_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, n_shingles, node), the nodes (node, rep, n, weight) and the labels of linked nodes."""
    spark: SparkSession = documents.sparkSession
    described = cut_lineage(
        documents.mapInArrow(_describe(n, bits), "doc_id bigint, n_shingles bigint, node bigint, slice int, counts binary")
    )
    classes = spark.sparkContext.broadcast(frequency_classes(described, bits))
    described = described.filter("slice IS NULL").select("doc_id", "n_shingles", "node")
    nodes = cut_lineage(
        described.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("weight"))
    )
    tokens = nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    blocks = max(16, -(-int(tokens) // block_tokens))

    lists, source = [], documents
    for order in range(orders):
        lists.append(prefix_lists(source, n, order, percent, blocks, classes))
        source = documents_of(documents, lists[-1].select("node"), nodes) if order + 1 < orders else source

    def candidates(pairs_of) -> DataFrame:
        return cut_lineage(reduce(lambda x, y: x.join(y, ["a", "b"]), (pairs_of(one) for one in lists)))

    stars = candidates(_stars)
    links = similar(stars, documents, nodes, n, percent)
    labels = components(links)
    rest = candidates(lambda one: _crossing(one, labels))
    links = links.unionByName(similar(rest, documents, nodes, n, percent))
    return described, nodes, components(links)


def _named(described: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, component_id) of every row."""
    least = labels.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut_lineage(labels.join(least, "component").select("node", "component_id"))
    named = cut_lineage(nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")))
    rows = described.join(named, "node", "left")
    return rows.select("node", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def join_components(documents: DataFrame, n: int = 5, percent: int = 75, orders: int = 2, bits: int = 22, block_tokens: int = 300_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document (doc_id, text)."""
    found = _search(documents.select("doc_id", "text"), n, percent, orders, bits, block_tokens)
    return _named(*found).drop("node")


def _compare(percent: int, pairs: bool):
    """The links between the two sides of a group, or within its only side.

    Either the pairs of nodes, or of each node the rows at the nodes it is linked with.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, c, x, d, y = (k.as_py() for k in key)
        diagonal = (c, x) == (d, y)
        group = group.combine_chunks()
        second = group.column("second").to_numpy().astype(bool)
        node = group.column("node").to_numpy()
        keep = np.sort(np.unique(node, return_index=True)[1])  # a node's set may come from several tasks
        group, second, node = group.take(pa.array(keep)), second[keep], node[keep]
        weight = group.column("weight").to_numpy()
        lists = group.column("tokens").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        token = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(size)
        left, right = np.flatnonzero(~second), np.flatnonzero(~second if diagonal else second)
        place = np.full(len(node), -1)
        place[right] = np.arange(len(right))
        owner = np.repeat(place, size)
        by = np.argsort(token, kind="stable")
        by = by[owner[by] >= 0]
        owner, counts = owner[by], np.bincount(token[by], minlength=token.max() + 1)
        starts = np.cumsum(counts) - counts
        totals, found = np.zeros(len(node), np.int64), [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for i in left if len(right) else ():
            own = token[ends[i] - size[i] : ends[i]]
            runs = counts[own]
            at = np.repeat(starts[own] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hits = right[100 * both >= percent * (size[i] + size[right] - both)]
            if diagonal:
                hits = hits[hits > i]
            totals[i] += weight[hits].sum()
            totals[hits] += weight[i]
            if pairs:
                found[0].append(np.minimum(node[hits], node[i]))
                found[1].append(np.maximum(node[hits], node[i]))
        if pairs:
            return pa.table({"a": np.concatenate(found[0]), "b": np.concatenate(found[1])})
        return pa.table({"node": node, "links": totals})

    return run


def _met(documents: DataFrame, nodes: DataFrame, labels: DataFrame, n: int, percent: int, compare_tokens: int):
    """(components of two nodes, whose link is known; the sets of all others, grouped as they meet)."""
    members = cut_lineage(labels.join(nodes, "node").select("node", "component", "weight", "rep", "n"))
    held = cut_lineage(members.groupBy("component").agg(F.count("*").alias("n_nodes"), F.min("node").alias("a"), F.max("node").alias("b")))
    twos, more = held.filter("n_nodes = 2"), held.filter("n_nodes > 2").select("component")
    # Sizes of linked sets differ by one class at most; the base is a little larger than their ratio.
    step = math.log(100 / percent * 1.001)
    members = members.join(small(more), "component").withColumn("class", F.floor(F.log("n") / step))
    members = cut_lineage(members)
    blocks = cut_lineage(
        members.groupBy("component", "class").agg(F.ceil(F.sum("n") / compare_tokens).cast("bigint").alias("blocks"))
    )
    above = blocks.select("component", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = blocks.select("component", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    by = ["component", "class"]
    blocks = cut_lineage(blocks.join(above, by, "left").join(below, by, "left").fillna(0))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    dealt = cut_lineage(members.join(small(blocks), by).select("node", "weight", *by, block, "blocks", "above", "below"))

    def meet(count: str, group) -> F.Column:
        numbers = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(count)), lambda b: b < F.col(count))
        return F.transform(numbers, lambda b: F.struct(*(c.alias(k) for k, c in zip(("c", "x", "d", "y", "second"), group(b)))))

    own, at = F.col("class"), F.col("block")
    meetings = F.concat(
        meet("blocks", lambda b: (own, F.least(at, b), own, F.greatest(at, b), at > b)),
        meet("above", lambda b: (own, at, own + 1, b, F.lit(False))),
        meet("below", lambda b: (own - 1, b, own, at, F.lit(True))),
    )
    texts = documents_of(documents, members.select("node"), nodes)
    sets = cut_lineage(texts.select("text").mapInArrow(_sets(n), "node bigint, tokens array<bigint>"))
    sent = sets.join(small(dealt), "node").withColumn("meeting", F.explode(meetings))
    sent = sent.select("node", "tokens", "weight", "component", "meeting.*")
    return twos, sent.groupBy("component", "c", "x", "d", "y")


def join_links(
    documents: DataFrame, n: int = 5, percent: int = 75, orders: int = 2, bits: int = 22, block_tokens: int = 300_000, compare_tokens: int = 100_000
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; its links are the other rows that are similar enough."""
    documents = documents.select("doc_id", "text")
    described, nodes, labels = _search(documents, n, percent, orders, bits, block_tokens)
    twos, met = _met(documents, nodes, labels, n, percent, compare_tokens)
    counted = met.applyInArrow(_compare(percent, False), "node bigint, links bigint")
    ends = twos.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("o")), F.struct(F.col("b").alias("node"), F.col("a").alias("o")))).alias("e"))
    known = ends.select("e.*").join(nodes.select(F.col("node").alias("o"), F.col("weight").alias("links")), "o").select("node", "links")
    links = cut_lineage(counted.unionByName(known).groupBy("node").agg(F.sum("links").alias("links")))
    links = cut_lineage(nodes.join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    rows = _named(described, nodes, labels).join(links, "node", "left")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def linked_pairs(
    documents: DataFrame, n: int = 5, percent: int = 75, orders: int = 2, bits: int = 22, block_tokens: int = 300_000, compare_tokens: int = 100_000
) -> DataFrame:
    """All links of different sets: the least ids at both nodes (a, b), and the rows there (a_rows, b_rows)."""
    documents = documents.select("doc_id", "text")
    _, nodes, labels = _search(documents, n, percent, orders, bits, block_tokens)
    twos, met = _met(documents, nodes, labels, n, percent, compare_tokens)
    pairs = met.applyInArrow(_compare(percent, True), "a bigint, b bigint").unionByName(twos.select("a", "b"))
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("rep").alias(f"{k}_rep"), F.col("weight").alias(f"{k}_rows"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    return pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), "a_rows", "b_rows")
