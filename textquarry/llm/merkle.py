"""Merkle manifest of a dataset, stored in van Emde Boas layout.

Each group of rows (a source) is a tree whose leaves ascend by a key; `ARITY` consecutive nodes
become their hash until one node remains, the subroot. The subroots, ordered by group, are the
leaves of one more tree, which gives the root.

A tree is cut into aligned blocks of `height` levels above their leaves. A block is one row whose
nodes lie in van Emde Boas order: the upper half of its levels first, then each lower subtree, all
laid out in the same way again. `address` finds a node by arithmetic alone, for construction and
for the siblings of a proof, whatever the size of a cache line or page. The roots of the blocks
are the leaves of the next layer of blocks, and so on up to the root of a tree; a proof follows the
layers down again, so a leaf meets one block and the path of that block, never a whole tree.

Places of leaves come from one range shuffle, written once: the rows of a range keep their order,
and each range adds the rows of its group before it. No group is held by one task.

Defined results: a null value hashes as `-`; a null group is a group of its own and comes first;
null keys come first, equal keys are ordered by leaf, so repeated rows are leaves of their own; an
empty table has no leaves and a null root; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

ARITY = 3
DIGEST = 32
HEIGHT = 6
BLOCKS = "tree bigint, block bigint, size bigint, n int, nodes binary, root string"
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """A value as text that can't run into its neighbour: its byte count, a colon, itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row, in lowercase hex."""
    return F.sha2(F.encode(F.concat(*map(field, values)), "UTF-8"), 256)


def tree_size(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // ARITY), height + 1
    return height


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of nodes `depth` levels below the root in a tree of `levels` levels, in van Emde Boas order."""
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, span = levels - upper, ARITY ** (depth - upper)
        place += tree_size(upper) + index // span * tree_size(lower)
        index, depth, levels = index % span, depth - upper, lower
    return place


def _hex(digests: np.ndarray) -> list[str]:
    text = digests.tobytes().hex()
    return [text[i : i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]


def _digests(text: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(text)), np.uint8).reshape(-1, DIGEST)


def build_nodes(leaves: list[str], height: int) -> np.ndarray:
    """All nodes of a block; nodes that don't exist are zero."""
    levels = height + 1
    nodes = np.zeros((tree_size(levels), DIGEST), np.uint8)
    n = len(leaves)
    nodes[address(height, np.arange(n), levels)] = _digests(leaves)
    for depth in range(height - 1, -1, -1):
        below = _hex(nodes[address(depth + 1, np.arange(n), levels)])
        runs = ("".join(below[i : i + ARITY]) for i in range(0, n, ARITY))
        n = -(-n // ARITY)
        made = b"".join(hashlib.sha256(run.encode()).digest() for run in runs)
        nodes[address(depth, np.arange(n), levels)] = np.frombuffer(made, np.uint8).reshape(n, DIGEST)
    return nodes


def siblings(nodes: np.ndarray, n: int, height: int) -> list[tuple[list[str], list[str]]]:
    """For each level from the leaves up: per node, its siblings to the left and to the right, joined."""
    levels, found = height + 1, []
    for depth in range(height, 0, -1):
        known = _hex(nodes[address(depth, np.arange(n), levels)])
        first = [i - i % ARITY for i in range(n)]
        before = ["".join(known[f:i]) for i, f in enumerate(first)]
        after = ["".join(known[i + 1 : f + ARITY]) for i, f in enumerate(first)]
        found.append((before, after))
        n = -(-n // ARITY)
    return found


def _by_block(rows: pa.Table):
    """(tree, block, rows by place) of the blocks of a shard."""
    rows = rows.sort_by([("tree", "ascending"), ("block", "ascending"), ("slot", "ascending")])
    tree, block = (rows[c].to_numpy() for c in ("tree", "block"))
    new = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *new.tolist(), len(tree)] if len(tree) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(tree[a]), int(block[a]), rows.slice(a, b - a)


def _build(height: int):
    def run(rows: pa.Table) -> pa.Table:
        out = []
        for tree, block, some in _by_block(rows):
            size = some["size"][0].as_py()
            levels = min(height, height_of(size))
            nodes = build_nodes(some["digest"].to_pylist(), levels)
            out.append((tree, block, size, len(some), nodes.tobytes(), nodes[0].tobytes().hex()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)]
        return pa.Table.from_arrays(columns, names=["tree", "block", "size", "n", "nodes", "root"])

    return run


def _paths_of(some: pa.Table, known: dict, height: int) -> pa.Array:
    """The paths of some leaves of one block: within the block by address, then the block's own."""
    slots = some["slot"].to_numpy().astype(np.int64)
    nodes = np.frombuffer(known["nodes"], np.uint8).reshape(-1, DIGEST)
    before, after, picks = [], [], []
    for left, right in siblings(nodes, known["n"], min(height, height_of(known["size"]))):
        picks.append(len(before) + slots)
        before += left
        after += right
        slots = slots // ARITY
    for step in known["path"] or []:
        picks.append(np.full(len(some), len(before)))
        before.append(step["before"])
        after.append(step["after"])
    index = pa.array(np.stack(picks, 1).ravel() if picks else np.zeros(0, np.int64), pa.int64())
    steps = pa.StructArray.from_arrays([pa.array(v, pa.string()).take(index) for v in (before, after)], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * len(picks), pa.int32()), steps)


def _prove(height: int, kept: list[str]):
    def run(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        stored = {(b["tree"], b["block"]): b for b in blocks.to_pylist()}
        none = rows.slice(0, 0).select(kept)
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        tables = [none.append_column("path", pa.array([], kind))]
        for tree, block, some in _by_block(rows):
            tables.append(some.select(kept).append_column("path", _paths_of(some, stored[tree, block], height)))
        return pa.concat_tables(tables)

    return run


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("tree", "block"), F.lit(shards)).cast("int"))


def _placed(rows: DataFrame, height: int) -> DataFrame:
    """Adds the block of each leaf and its place there."""
    span = F.lit(ARITY**height).cast("bigint")
    return rows.withColumn("block", F.floor(F.col("pos") / span).cast("bigint")).withColumn("slot", F.pmod("pos", span).cast("int"))


def _block_roots(layer: DataFrame, height: int) -> DataFrame:
    """The leaves of the next layer: the block roots of trees that have more than one."""
    span = F.lit(ARITY**height).cast("bigint")
    size = F.ceil(F.col("size") / span).cast("bigint").alias("size")
    return layer.where(F.col("size") > span).select("tree", F.col("block").alias("pos"), size, F.col("root").alias("digest"))


@dataclass(frozen=True)
class Forest:
    """Trees over `leaves` (tree, pos, size, digest); a layer of blocks for every `height` levels."""

    leaves: DataFrame
    layers: list[DataFrame]
    height: int
    shards: int

    def roots(self) -> DataFrame:
        """tree, root: the only block of a tree in its highest layer."""
        tops = [layer.where(F.col("size") <= ARITY**self.height).select("tree", "root") for layer in self.layers]
        return reduce(DataFrame.unionByName, tops)

    def paths(self, above: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
        """Every leaf (tree, pos and the columns to carry) with its path to the root of its tree.

        `above` (tree, path) carries the paths on beyond the roots.
        """
        path = None
        for i in range(len(self.layers) - 1, -1, -1):
            blocks = self.layers[i].select("tree", "block", "size", "n", "nodes")
            if path is None:
                blocks = blocks.withColumn("upper", F.lit(None).cast(PATH))
            else:
                known = path.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"))
                blocks = blocks.join(known, ["tree", "block"], "left")
            if above is not None:
                beyond = above.select("tree", F.col("path").alias("beyond"))
                blocks = blocks.join(beyond, "tree", "left").withColumn("upper", F.coalesce("upper", "beyond"))
            blocks = blocks.select("tree", "block", "size", "n", "nodes", F.col("upper").alias("path"))
            kept = ["tree", "pos"] if i else ["tree", "pos", *carry]
            rows = (_block_roots(self.layers[i - 1], self.height) if i else self.leaves).select(*kept)
            left, right = (_dealt(side, self.shards).groupBy("shard") for side in (_placed(rows, self.height), blocks))
            path = left.cogroup(right).applyInArrow(_prove(self.height, kept), rows.withColumn("path", F.lit(None).cast(PATH)).schema)
            if i:
                path = cut_lineage(path)
        return path


def build_forest(leaves: DataFrame, height: int = HEIGHT, shard_rows: int = 20_000) -> Forest:
    """All blocks of the trees over (tree, pos, size, digest), each layer written before the next."""
    most, rows = leaves.agg(F.max("size"), F.count("*")).first()
    shards = max(256, -(-rows // shard_rows))
    layers, nodes = [], leaves.select("tree", "pos", "size", "digest")
    while True:
        built = _dealt(_placed(nodes, height), shards).groupBy("shard").applyInArrow(_build(height), BLOCKS)
        layers.append(cut_lineage(built))
        if most is None or most <= ARITY**height:
            return Forest(leaves, layers, height, shards)
        most = -(-most // ARITY**height)
        nodes = _block_roots(layers[-1], height)


def _ranked(rows: DataFrame, group: str | None, order: Sequence[str], range_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The rows in order, written once with `at`, and what each range adds to the places in it.

    `at` holds the number of the range and the place there, so a row's place in its group is the
    `start` of its range plus its distance from the `first` row of the group there.
    """
    groups = [group] if group else []
    ranges = max(32, -(-rows.count() // range_rows))
    ordered = rows.repartitionByRange(ranges, *groups, *order).sortWithinPartitions(*groups, *order)
    rows = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy(*groups, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*groups) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("size", F.sum("rows").over(whole))
    return rows, cut_lineage(runs.select(*groups, "part", "first", "start", "size"))


@dataclass(frozen=True)
class Manifest:
    """The trees of the groups, the tree of their subroots, and its root (null without leaves)."""

    trees: Forest
    top: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf (tree, pos, digest, row) with its path, subroot and root."""
        subroots = self.trees.roots().withColumnRenamed("root", "subroot")
        above = cut_lineage(self.top.paths().select(F.col("pos").alias("tree"), "path"))
        rows = self.trees.paths(above, ["digest", "row"])
        return rows.join(subroots, "tree").withColumn("root", F.lit(self.root))


def build_manifest(rows: DataFrame, group: str, key: str, digest: str, carry: Sequence[str] = (), height: int = HEIGHT) -> Manifest:
    """The manifest of rows with a group, a key and a leaf digest; `carry` columns come along in `row`."""
    held = F.struct(F.col(group).alias("group"), F.col(key).alias("key"), *(F.col(c) for c in carry)).alias("row")
    rows = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(digest).alias("digest"), held)
    rows, runs = _ranked(rows, "group", ["key", "digest"])
    groups, starts = _ranked(runs.groupBy("group").agg(F.max("size").alias("rows")), None, ["group"])
    at = (F.col("start") + F.col("at") - F.col("first")).cast("bigint")
    numbered = groups.join(starts, "part").select(F.col("group").alias("of"), at.alias("tree"))
    runs = runs.join(numbered, F.col("group").eqNullSafe(F.col("of"))).drop("of")
    runs = runs.select(F.col("group").alias("of"), F.col("part").alias("range"), "first", "start", "size", "tree")
    placed = rows.join(runs, (F.col("part") == F.col("range")) & F.col("group").eqNullSafe(F.col("of")))
    trees = build_forest(cut_lineage(placed.select("tree", at.alias("pos"), "size", "digest", "row")), height)
    return _crowned(trees)


def _crowned(trees: Forest) -> Manifest:
    """The manifest of some trees: their subroots, in order, are the leaves of one tree more."""
    subroots = cut_lineage(trees.roots())
    size = F.lit(subroots.count()).cast("bigint").alias("size")
    one = F.lit(0).cast("bigint").alias("tree")
    top = build_forest(subroots.select(one, F.col("tree").alias("pos"), size, F.col("root").alias("digest")), trees.height)
    root = top.roots().first()
    return Manifest(trees, top, root["root"] if root else None)


def joined_path(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, digest, lambda held, s: F.sha2(F.encode(F.concat(s["before"], held, s["after"]), "UTF-8"), 256))


def save(manifest: Manifest, path: str) -> None:
    """Write the leaves and the blocks of all layers; the tree above is built again when loaded."""
    manifest.trees.leaves.write.parquet(f"{path}/leaves")
    layers = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(manifest.trees.layers)]
    reduce(DataFrame.unionByName, layers).write.partitionBy("layer").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str, height: int = HEIGHT, shards: int = 256) -> Manifest:
    """A saved manifest that holds at least one leaf; `height` as it was built."""
    count = spark.read.parquet(f"{path}/blocks").agg(F.max("layer")).first()[0] + 1
    layers = [spark.read.parquet(f"{path}/blocks").where(F.col("layer") == i).drop("layer") for i in range(count)]
    return _crowned(Forest(spark.read.parquet(f"{path}/leaves"), layers, height, shards))
