"""Near-duplicates over a whole corpus: a set-similarity self-join of chunk token sets.

Two chunks are linked when both have enough distinct tokens and the Jaccard similarity of their
token sets reaches the threshold, the rule that search applies within one pool.

Equal sets are one node with a number of copies. Sets that are similar enough differ in a bounded
number of tokens, by their sizes; dealt by hash to one part more than that, their tokens agree in a whole
part. A node is listed by the hashes of its parts, for the two ranges of sizes that it can be
similar in, so a list holds hardly any others than near copies. In a list, sizes and sketches (bits of the
tokens, of which similar sets differ in few) show who can be similar, and that joins nodes to groups.
Only nodes of a group come with their tokens, once if the group is small: it is cut into blocks of nodes, and
each pair of blocks is compared in one place, sizes first, then the sets. A pair so is counted once.
What leaves a comparison is one row per node that has a link, with its links and a neighbour, and never
the pairs.

Defined results: a chunk without text or with too few tokens has no links and is its own class;
chunk ids are taken as given, also repeated; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.fusion import token_set
from textquarry.session import cut_lineage
from textquarry.settings import SEARCH, SearchSettings

SLACK = 1e-6
SKETCH_BITS = 512
GROUPED = "node binary, neighbour binary"
LINKED = "node binary, links bigint, neighbour binary"


def join_by_share(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 10_000) -> DataFrame:
    """Join rows to facts, which have one row per key and in `weight` the number of rows that hold it.

    Keys with more than one in `share` of the rows, fewer than `share` of them, go to all tasks;
    the others meet in a shuffle, where no key is large.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) * share > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def token_nodes(chunks: DataFrame, settings: SearchSettings = SEARCH) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, n_tokens, node) of every chunk, node null for short ones, and of the others (node, chunk_id, copies, n, tokens).

    A node has a row, of one copy, for every chunk with its set.
    """
    found = chunks.select("chunk_id", F.array_sort(F.coalesce(token_set(F.col("content")), F.array().cast("array<string>"))).alias("_tokens"))
    long = F.size("_tokens") >= settings.near_min_tokens
    digest = F.unhex(F.left(F.sha2(F.encode(F.array_join("_tokens", " "), "UTF-8"), 256), F.lit(32)))
    members = cut_lineage(
        found.select(
            "chunk_id", F.size("_tokens").alias("n_tokens"), F.when(long, digest).alias("node"),
            F.when(long, F.transform("_tokens", lambda t: F.xxhash64(t))).alias("tokens"),
        )
    )
    nodes = members.where("node IS NOT NULL").select("node", "chunk_id", F.lit(1).cast("bigint").alias("copies"), F.col("n_tokens").alias("n"), "tokens")
    return members.drop("tokens"), nodes


def _differing(threshold: float, sizes: int) -> int:
    """The most tokens in which two sets differ that are similar and have so many tokens together."""
    return math.floor((1 - threshold) / (1 + threshold) * sizes + SLACK)


def size_ranges(largest: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first size of each range up to one with ``largest``, and the parts for pairs whose smaller set lies in it.

    The other set of a similar pair lies in the same range or in the next.
    """
    firsts, parts = [1], []
    while firsts[-1] <= largest:
        last = max(firsts[-1], math.floor(firsts[-1] / threshold + SLACK))
        parts.append(_differing(threshold, last + math.floor(last / threshold + SLACK)) + 1)
        firsts.append(last + 1)
    return np.array(firsts[:-1] or [1], np.int64), np.array(parts or [1], np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all rows, mixed, and how many each row has."""
    tokens = batch["tokens"]
    return _mixed(tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)), tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(threshold: float):
    """(part, node): the hashes of a node's parts, for pairs in which it is the smaller and the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, n = _tokens_of(batch)
            firsts, parts = size_ranges(int(n.max(initial=1)), threshold)
            own = np.searchsorted(firsts, n, "right") - 1
            for range_of in (own, np.maximum(own - 1, 0)):
                many = parts[range_of]
                begins = np.cumsum(many) - many
                sums = np.zeros(int(many.sum()), np.uint64)
                np.add.at(sums, np.repeat(begins, n) + (token % np.repeat(many, n).astype(np.uint64)).astype(np.int64), _mixed(token))
                row = np.repeat(np.arange(len(n)), many)
                place = (range_of[row].astype(np.uint64) << np.uint64(32)) + (np.arange(len(row)) - begins[row]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(sums + _mixed(place)).view(np.int64)), batch["node"].take(pa.array(row))], ["part", "node"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, copies, n, sketch): each token turns one of the sketch's bits, so sets differ in no fewer tokens than bits."""
    for batch in batches:
        token, n = _tokens_of(batch)
        bits = np.zeros((len(n), SKETCH_BITS), np.uint8)
        np.add.at(bits, (np.repeat(np.arange(len(n)), n), (token % np.uint64(SKETCH_BITS)).astype(np.int64)), 1)
        packed = np.packbits(bits & 1, axis=1)
        sketch = pa.Array.from_buffers(pa.binary(SKETCH_BITS // 8), len(n), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch["node"], batch["copies"], batch["n"], sketch], ["node", "copies", "n", "sketch"])


class _Sets:
    """The token sets of a shard's rows, ready for many comparisons at once."""

    def __init__(self, rows: pa.Table):
        tokens = rows["tokens"].combine_chunks()
        self.sizes = tokens.value_lengths().to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        _, self.local = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        self.width = int(self.local.max(initial=0)) + 1
        self.keys = np.sort(np.repeat(np.arange(len(rows)), self.sizes) * self.width + self.local)

    def shared(self, a: np.ndarray, b: np.ndarray, most: int = 1 << 21) -> np.ndarray:
        """How many of the tokens of each row in `a` the row in `b` has."""
        counts, at = np.zeros(len(a), np.int64), 0
        ends = np.cumsum(self.sizes[a])
        while at < len(a):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            span = self.sizes[a[at:until]]
            pair = np.repeat(np.arange(at, until), span)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(span) - span, span)
            wanted = b[pair] * self.width + self.local[self.starts[a[pair]] + within]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            counts[at:until] = np.bincount(pair[self.keys[place] == wanted] - at, minlength=until - at)
            at = until
        return counts


def _unit_pairs(edges: np.ndarray, block: np.ndarray, crossing: np.ndarray, most: int):
    """(a, b) of all rows that meet in a unit, in batches of about `most`; rows lie by unit."""
    held, size = [], 0
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if crossing[begin]:
            split = begin + int(np.count_nonzero(block[begin:end] == block[begin]))
            left, right = np.arange(begin, split), np.arange(split, end)
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            a, b = (x + begin for x in np.triu_indices(end - begin, 1))
        held.append((a, b))
        size += len(a)
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after each a is joined to its b: the least place that a place reaches."""
    while True:
        least = np.minimum(root[a], root[b])
        lower = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(lower, x, least)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


class _Unit:
    """The rows of a shard, those that meet beside each other, and what is found of their nodes."""

    def __init__(self, rows: pa.Table):
        self.rows = rows = rows.sort_by([(c, "ascending") for c in ("key", "low", "high", "block")])
        key, self.low, self.high, self.block = (rows[c].to_numpy() for c in ("key", "low", "high", "block"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (self.low[1:] != self.low[:-1]) | (self.high[1:] != self.high[:-1])) + 1
        self.edges = np.concatenate([[0], new, [len(key)]])
        nodes, self.node = np.unique(np.array(rows["node"].to_pylist(), "S16"), return_inverse=True)
        self.names = rows["node"].combine_chunks().take(pa.array(np.unique(self.node, return_index=True)[1]))
        self.n, self.root = rows["n"].to_numpy().astype(np.int64), np.arange(len(nodes))

    def pairs(self, threshold: float, most: int):
        """(a, b) of rows that meet and whose sizes can be similar, in batches."""
        for a, b in _unit_pairs(self.edges, self.block, self.low != self.high, most):
            keep = np.minimum(self.n[a], self.n[b]) >= threshold * np.maximum(self.n[a], self.n[b]) - SLACK
            yield a[keep], b[keep]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.root = _joined(self.root, self.node[a], self.node[b])

    def found(self, met: np.ndarray, **columns: np.ndarray) -> pa.Table:
        named = {"node": self.names.take(pa.array(met)), "neighbour": self.names.take(pa.array(self.root[met]))}
        return pa.table(named | {name: pa.array(values[met]) for name, values in columns.items()})


def _grouped(threshold: float, most: int = 1 << 18):
    """Of the nodes in a list, (node, neighbour): those whose sizes and sketches can be similar."""

    def run(rows: pa.Table) -> pa.Table:
        unit = _Unit(rows)
        sketch = np.frombuffer(b"".join(unit.rows["sketch"].to_pylist()), np.uint64).reshape(len(unit.rows), -1)
        met = np.zeros(len(unit.root), bool)
        for a, b in unit.pairs(threshold, most):
            bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)
            near = bits <= (1 - threshold) / (1 + threshold) * (unit.n[a] + unit.n[b]) + SLACK
            a, b = a[near], b[near]
            apart = unit.node[a] != unit.node[b]
            unit.join(a[apart], b[apart])
            met[unit.node[a[apart]]] = met[unit.node[b[apart]]] = True
        return unit.found(np.flatnonzero(met)).select(["node", "neighbour"])

    return run


def _linked(threshold: float, most: int = 1 << 18):
    """Of the nodes in a group, (node, links, neighbour): those whose sets are similar."""

    def run(rows: pa.Table) -> pa.Table:
        unit = _Unit(rows)
        sets, n, node = _Sets(unit.rows), unit.n, unit.node
        copies, links = unit.rows["copies"].to_numpy(), np.zeros(len(unit.root), np.int64)
        for a, b in unit.pairs(threshold, most):
            both = sets.shared(a, b)
            similar = both / (n[a] + n[b] - both) >= threshold
            a, b = a[similar], b[similar]
            np.add.at(links, node[a], copies[b])
            np.add.at(links, node[b], copies[a])
            unit.join(a, b)
        return unit.found(np.flatnonzero(links), links=links).select(["node", "links", "neighbour"])

    return run


def _units(rows: DataFrame, block_nodes: int, members: str) -> DataFrame:
    """A row for every block that a row's node meets, itself included; ``members`` counts the rows with its key."""
    blocks = F.ceil(F.col(members) / block_nodes).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return units.select("node", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _in_shards(units: DataFrame, met: int, shard_rows: int) -> DataFrame:
    """Groups of units, about so many rows each; units that meet lie in one."""
    shards = max(64, -(-met // shard_rows))
    return units.withColumn("shard", F.pmod(F.xxhash64("key", "low", "high"), F.lit(shards)).cast("int")).groupBy("shard")


def _met(lists: DataFrame, members: str, block_nodes: int) -> int:
    return lists.agg(F.sum(F.col(members) * F.ceil(F.col(members) / block_nodes))).first()[0] or 0


def near_groups(nodes: DataFrame, facts: DataFrame, threshold: float, block_nodes: int = 512, shard_rows: int = 32_000) -> DataFrame:
    """(node, label) of every node that another can be similar to; similar nodes have one label.

    ``facts`` have node, n and sketch once per node.
    """
    listed = nodes.select("node", "tokens").mapInArrow(_listed(threshold), "part bigint, node binary")
    first = F.xxhash64("node")
    lists = cut_lineage(
        listed.groupBy(F.col("part").alias("key")).agg(F.count("*").alias("length"), F.min(first).alias("_least"), F.max(first).alias("_most"))
        .where("_least <> _most").select("key", "length")
    )
    met = join_by_share(listed.withColumnRenamed("part", "key"), lists, "key", "length").distinct()
    units = _units(met, block_nodes, "length").join(facts.select("node", "n", "sketch"), "node")
    found = cut_lineage(_in_shards(units, _met(lists, "length", block_nodes), shard_rows).applyInArrow(_grouped(threshold), GROUPED))
    return least_labels(found.where("node <> neighbour").select(F.col("node").alias("a"), F.col("neighbour").alias("b")))


def linked_nodes(nodes: DataFrame, threshold: float, block_nodes: int = 512, shard_rows: int = 8_000) -> DataFrame:
    """node, links (chunks of other nodes it is linked to), neighbour; several rows per node.

    ``nodes`` (node, copies, n, tokens) can hold a node more than once; its copies add up.
    """
    facts = nodes.select("node", "copies", "n", "tokens").mapInArrow(_sketched, "node binary, copies bigint, n int, sketch binary")
    facts = cut_lineage(facts.groupBy("node").agg(F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    labels = near_groups(nodes, facts, threshold, block_nodes)
    grouped = labels.join(facts.drop("sketch"), "node").withColumn("key", F.xxhash64("label"))
    grouped = cut_lineage(grouped.drop("label"))
    groups = cut_lineage(grouped.groupBy("key").agg(F.count("*").alias("members")))
    sets = nodes.select("node", "tokens").join(grouped.select("node"), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))
    sets = grouped.select("node", "copies", "n").join(sets, "node")
    units = _units(join_by_share(grouped.select("node", "key"), groups, "key", "members"), block_nodes, "members").join(sets, "node")
    return cut_lineage(_in_shards(units, _met(groups, "members", block_nodes), shard_rows).applyInArrow(_linked(threshold), LINKED))


def least_labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node that a node reaches over links (a, b).

    A round takes the least label among the neighbours, then the label of that label, so a chain
    needs a logarithmic number of rounds; every round is a written table.
    """
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        labels = cut_lineage(labels)
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = cut_lineage(
            labels.join(near, labels.node == near.a, "left")
            .select("node", F.col("label").alias("before"), F.least("label", F.coalesce("near", "label")).alias("label"))
        )
        jump = lower.select(F.col("node").alias("of"), F.col("label").alias("next"))
        moved = cut_lineage(lower.join(jump, lower.label == jump.of, "left").select("node", "before", F.coalesce("next", "label").alias("label")))
        if not moved.where("label <> before").limit(1).count():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def corpus_near_duplicates(chunks: DataFrame, settings: SearchSettings = SEARCH, block_nodes: int = 512) -> DataFrame:
    """chunk_id, n_tokens, class_id (least chunk_id reached over links), n_links of every chunk (chunk_id, content)."""
    members, nodes = token_nodes(chunks, settings)
    linked = linked_nodes(nodes, settings.near_jaccard, block_nodes)
    labels = least_labels(linked.where("node <> neighbour").select(F.col("node").alias("a"), F.col("neighbour").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.groupBy("node").agg(F.min("chunk_id").alias("first_chunk"), F.sum("copies").alias("copies"))
    classed = cut_lineage(known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    firsts = classed.groupBy("label").agg(F.min("first_chunk").alias("class_id"))
    facts = cut_lineage(
        classed.join(firsts, "label").join(counts, "node", "left")
        .select("node", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    known = join_by_share(members.where("node IS NOT NULL"), facts, "node", "copies").select("chunk_id", "n_tokens", "class_id", "n_links")
    short = members.where("node IS NULL").select("chunk_id", "n_tokens", F.col("chunk_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return known.unionByName(short)
