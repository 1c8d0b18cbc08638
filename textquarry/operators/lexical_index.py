"""Full-text index in blocks: the largest impact of a term in a run of chunks decides what is read.

Chunks are numbered in the order in which they are stored, so chunks of one file lie together;
``SEGMENT_CHUNKS`` of them are a segment and ``STRETCH_SEGMENTS`` segments a stretch. A block holds
the postings of a term in a stretch, packed, and the largest impact in each of its segments. The
chunks of a stretch lie in one task, so blocks are made there and only they are shuffled, those of a
stretch and folder as one compressed row. Blocks lie in folders by a hash of the term, ordered by term.

A search brings the blocks of the asked terms together by stretch, one row each. In that row it first
adds up the largest impacts per segment: no chunk of a segment can rank higher than that sum.
Segments that cannot reach the last wanted hit a task has met are skipped, the others are
multiplied with the questions, and only hits that can still be among the best leave the task. The
hits are those of ``lexical.lexical_search``, ties included.

Counts for the weights of terms are kept beside the blocks: per run, what its chunks add to the
number of chunks and of chunks with a term, and what the versions they replace take away. A search
sums the rows of its terms and reads neither chunks nor postings for them.

Defined results: a chunk without terms has no postings, yet counts as a chunk; a repeated chunk_id
is a chunk of its own in the counts, as in ``term_statistics``; an empty index answers nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.operators import lexical
from textquarry.session import cut_lineage
from textquarry.sources.sinks import in_folders

SEGMENT_BITS = 4
SEGMENT_CHUNKS = 1 << SEGMENT_BITS
STRETCH_BITS = 8
STRETCH_SEGMENTS = 1 << STRETCH_BITS
#: Segments that are multiplied with the questions at once.
SCORED_SEGMENTS = 32
BUCKETS = 64
#: Scores are compared with this much room, since bounds are sums in another order.
ROOM = 1e-6


@dataclass(frozen=True)
class LexicalIndex:
    """``blocks``: bucket, repository_id, term, stretch, segments, impacts, hits, hit_names, hit_bodies,
    hit_lengths; ``places``: repository_id, segment, slot, chunk_id; ``term_counts``: repository_id, term,
    df; ``repository_counts``: repository_id, chunks, lexical_chunks. Blocks of a term and stretch and
    counts may come in several rows, which add up."""

    blocks: DataFrame
    places: DataFrame
    term_counts: DataFrame
    repository_counts: DataFrame


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds segment and slot. ``chunks`` must be a stored table, whose rows come in one order."""
    place = F.monotonically_increasing_id()
    return chunks.select("*", place.alias("_place")).select(
        *chunks.columns,
        F.shiftright("_place", SEGMENT_BITS).alias("segment"),
        F.col("_place").bitwiseAND(SEGMENT_CHUNKS - 1).cast("int").alias("slot"),
    )


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


BLOCK = (
    "repository_id string, term string, stretch bigint, segments binary, impacts binary, hits binary, hit_names binary, hit_bodies binary, "
    "hit_lengths binary"
)


def _blobs(values: np.ndarray, edges: np.ndarray, kept: np.ndarray | None = None) -> pa.Array:
    """The bytes of each run of values; nothing for runs that are not kept."""
    sizes = np.diff(edges)
    if kept is not None:
        values, sizes = values[np.repeat(kept, sizes)], sizes * kept
    offsets = np.append(0, np.cumsum(sizes * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = counts.max() if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _counts(blob: bytes, n: int) -> np.ndarray:
    """Counts of n hits, in one, two or four bytes each; nothing is stored if all are 0."""
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.float64) if blob else np.zeros(n)


def _blocks_of(rows: pa.Table) -> pa.RecordBatch:
    """The blocks of some chunks of one stretch."""
    rows = rows.combine_chunks()
    column = lambda name: rows[name].chunk(0)
    segment = column("segment").to_numpy(zero_copy_only=False).astype(np.int64)
    own = segment & (STRETCH_SEGMENTS - 1)
    place = (own << SEGMENT_BITS) | column("slot").to_numpy(zero_copy_only=False)
    repositories = column("repository_id").dictionary_encode()
    repository = repositories.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = column("terms")
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    found = lists.flatten()
    coded = found.field("term").dictionary_encode()
    names, bodies = (found.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tf_names", "tf_body"))
    width = max(len(coded.dictionary), 1)
    key = repository[row] * width + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort((key << (STRETCH_BITS + SEGMENT_BITS)) | place[row], kind="stable")
    key, row, names, bodies = key[order], row[order], names[order], bodies[order]
    lengths = column("chunk_terms").to_numpy(zero_copy_only=False).astype(np.float64)
    impact = (names * lexical.NAME_WEIGHT + bodies * lexical.BODY_WEIGHT) / (1 + np.log(lengths[row]))
    opens = np.flatnonzero(np.diff(key, prepend=-2))
    edges = np.append(opens, len(key))
    parts = np.flatnonzero((np.diff(key, prepend=-2) != 0) | (np.diff(own[row], prepend=-1) != 0))
    largest = np.maximum.reduceat(impact, parts)
    part_edges = np.searchsorted(parts, edges)
    most = lambda counts: np.maximum.reduceat(counts, opens) > 0
    return pa.record_batch(
        {
            "repository_id": repositories.dictionary.take(pa.array(key[opens] // width)),
            "term": coded.dictionary.take(pa.array(key[opens] % width)),
            "stretch": pa.array(np.full(len(opens), segment[0] >> STRETCH_BITS)),
            "segments": _blobs(own[row[parts]].astype(np.uint8), part_edges),
            # Rounded up, so that they stay bounds.
            "impacts": _blobs(np.nextafter(largest.astype(np.float32), np.float32(np.inf)), part_edges),
            "hits": _blobs(place[row].astype(np.uint16), edges),
            "hit_names": _blobs(_narrow(names), edges, most(names)),
            "hit_bodies": _blobs(_narrow(bodies), edges, most(bodies)),
            "hit_lengths": _blobs(_narrow(lengths[row]), edges),
        }
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        stretch = batch.column("segment").to_numpy(zero_copy_only=False) >> STRETCH_BITS
        edges = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), len(stretch)]
        for low, high in zip(edges[:-1], edges[1:]):
            if high == low:
                continue
            if held and stretch[low] != at:
                yield _blocks_of(pa.Table.from_batches(held))
                held = []
            at = stretch[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield _blocks_of(pa.Table.from_batches(held))


def build_blocks(postings: DataFrame) -> DataFrame:
    """A row per repository, term and stretch; ``postings`` carry segment and slot.

    The chunks of a stretch lie one behind the other in a task, which packs them without a shuffle. A
    stretch that a task begins and another ends has two rows for a term that both hold.
    """
    return _with_terms(postings).mapInArrow(_stretches, BLOCK).withColumn("bucket", term_bucket(F.col("term")))


def _with_terms(postings: DataFrame) -> DataFrame:
    return lexical.packed(postings).where(F.size("terms") > 0).select("repository_id", "segment", "slot", "chunk_terms", "terms")


VARYING = ("repository_id", "term", "segments", "impacts", "hits", "hit_names", "hit_bodies", "hit_lengths")


def _bundle(blocks: pa.RecordBatch) -> bytes:
    """Some blocks as compressed bytes; sizes instead of offsets, since most sizes are alike."""
    row = {}
    for name in VARYING:
        column = blocks.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2] or pa.py_buffer(b"")
        row[f"{name}_sizes"] = pa.array([np.diff(offsets).tobytes()], pa.binary())
        row[name] = pa.array([data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()], pa.binary())
    batch, sink = pa.record_batch(row), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a stretch that go to one folder, by repository and term, as one row."""
    for blocks in _stretches(batches):
        if not len(blocks):
            continue
        named = blocks.column("term").dictionary_encode()
        code = named.indices.to_numpy()
        hashes = np.array([zlib.crc32(t.encode()) % BUCKETS for t in named.dictionary.to_pylist()], np.int64)
        rank = np.empty(len(hashes), np.int64)
        rank[pc.sort_indices(named.dictionary).to_numpy()] = np.arange(len(hashes))
        repository = blocks.column("repository_id").dictionary_encode().indices.to_numpy()
        order = np.lexsort((rank[code], repository, hashes[code]))
        blocks, bucket = blocks.take(pa.array(order)), hashes[code[order]]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
        rows = [_bundle(blocks.slice(low, high - low)) for low, high in zip(edges[:-1], edges[1:])]
        stretch = np.full(len(rows), blocks.column("stretch")[0].as_py())
        yield pa.record_batch({"bucket": pa.array(bucket[edges[:-1]].astype(np.int32)), "stretch": pa.array(stretch), "rows": pa.array(rows, pa.binary())})


def _unbundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, stretch, bundle in zip(batch.column("bucket"), batch.column("stretch"), batch.column("rows")):
            row = pa.ipc.open_stream(bundle.as_buffer()).read_next_batch()
            made = {}
            for name in VARYING:
                sizes = np.frombuffer(row.column(f"{name}_sizes")[0].as_buffer(), np.int32)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                kind = pa.string() if name in ("repository_id", "term") else pa.binary()
                made[name] = pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), row.column(name)[0].as_buffer()])
            repository, term, *fields = made.items()
            stretches = pa.array(np.full(len(repository[1]), stretch.as_py()))
            buckets = pa.array(np.full(len(stretches), bucket.as_py(), np.int32))
            yield pa.record_batch(dict([repository, term, ("stretch", stretches), *fields, ("bucket", buckets)]))


def stored_blocks(postings: DataFrame, spread: int = 4) -> DataFrame:
    """The rows of ``build_blocks`` as they are stored: a folder per bucket, dealt to `spread` files, each ordered by term."""
    bundles = _with_terms(postings).mapInArrow(_bundled, "bucket int, stretch bigint, rows binary")
    dealt = bundles.repartition("bucket", F.pmod(F.col("stretch"), F.lit(spread)))
    return dealt.mapInArrow(_unbundled, f"{BLOCK}, bucket int").sortWithinPartitions("bucket", "repository_id", "term", "stretch")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["repository_id", "term"]).aggregate([("df", "sum")])
        yield from sums.rename_columns(["repository_id", "term", "df"]).to_batches()


def block_counts(blocks: DataFrame) -> DataFrame:
    """What stored blocks add to the chunks of each term: ``term_counts`` without a shuffle, where rows add up."""
    hits = blocks.select("repository_id", "term", (F.octet_length("hits") / 2).cast("bigint").alias("df"))
    return hits.mapInArrow(_counted, "repository_id string, term string, df bigint")


def places(postings: DataFrame) -> DataFrame:
    rows = postings.select("repository_id", "segment", "slot", "chunk_id", *(["terms"] if "terms" in postings.columns else []))
    if "terms" in rows.columns:  # a row per chunk already
        return rows.where(F.size("terms") > 0).drop("terms")
    return rows.distinct()


def term_counts(postings: DataFrame, sign: int = 1) -> DataFrame:
    """What some chunks add to (or, with sign -1, take from) the chunks of each term."""
    return lexical.unpacked(postings).groupBy("repository_id", "term").agg((F.count("*") * sign).alias("df"))


def repository_counts(chunks: DataFrame, postings: DataFrame, sign: int = 1) -> DataFrame:
    """What some chunks add to the chunks of a repository, and to those with a term in the body."""
    if "terms" in postings.columns:
        named = postings.where(F.array_max(F.col("terms.tf_body")) > 0)
    else:
        named = postings.where("tf_body > 0").groupBy("repository_id", "chunk_id").agg(F.lit(1).alias("one"))
    return counted_repositories(chunks, named, sign)


def counted_repositories(chunks: DataFrame, named: DataFrame, sign: int = 1) -> DataFrame:
    """``repository_counts`` of chunks, of which ``named`` has a row for each with a term in the body."""
    whole = chunks.groupBy("repository_id").agg((F.count("*") * sign).alias("chunks"))
    lexical_chunks = named.groupBy("repository_id").agg((F.count("*") * sign).alias("lexical_chunks"))
    zero = F.lit(0).cast("bigint")
    return whole.join(lexical_chunks, "repository_id", "left").withColumn("lexical_chunks", F.coalesce("lexical_chunks", zero))


def stored_statistics(index: LexicalIndex, query_term_rows: DataFrame) -> DataFrame:
    """The columns of ``lexical.term_statistics`` for the asked terms, from stored counts alone."""
    asked = query_term_rows.select("repository_id", "term").distinct()
    counted = index.term_counts.join(asked, ["repository_id", "term"], "left_semi").groupBy("repository_id", "term").agg(F.sum("df").alias("df"))
    totals = index.repository_counts.groupBy("repository_id").agg(F.sum("chunks").alias("total_chunks"), (F.sum("lexical_chunks") > 0).alias("lexical_available"))
    zero = F.lit(0).cast("bigint")
    stats = asked.join(counted, ["repository_id", "term"], "left").join(totals, "repository_id", "left").select(
        "repository_id", "term",
        F.coalesce("total_chunks", zero).alias("total_chunks"),
        F.coalesce("df", zero).alias("df"),
        F.coalesce("lexical_available", F.lit(False)).alias("lexical_available"),
    )
    weight, useful = lexical.idf(F.col("total_chunks"), F.col("df")), lexical.is_informative(F.col("total_chunks"), F.col("df"))
    return stats.withColumn("idf", weight).withColumn("informative", useful)


HEADS = ("segments", "impacts")
HITS = (*HEADS, "hits", "hit_names", "hit_bodies", "hit_lengths")


def _asked_stretches(blocks: DataFrame, searchable: DataFrame, fields: tuple[str, ...], places: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """A row per stretch with an asked term and per part of the queries: blocks (some fields of them), chunks, asked."""
    size = searchable.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries")).first()
    parts = max(1, -(-size["queries"] // lexical.BLOCK_QUERIES))
    asked = searchable.groupBy("repository_id", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(
        F.collect_list(F.struct("query_id", "position", "term", "idf")).alias("asked")
    )
    keys = ["bucket", "repository_id", "term"]
    held = blocks.select(*keys, "stretch", *fields).join(searchable.select(*keys).distinct(), keys, "left_semi")
    held = held.groupBy("repository_id", "stretch").agg(F.collect_list(F.struct("term", *fields)).alias("blocks"))
    if places is not None:
        chunk = F.struct((F.col("segment").bitwiseAND(STRETCH_SEGMENTS - 1) * SEGMENT_CHUNKS + F.col("slot")).cast("int").alias("place"), "chunk_id")
        named = places.groupBy("repository_id", F.shiftright("segment", STRETCH_BITS).alias("stretch")).agg(F.collect_list(chunk).alias("chunks"))
        held = held.join(named, ["repository_id", "stretch"])
    if size["rows"] <= lexical.BROADCAST_TERMS:
        return held.join(F.broadcast(asked), "repository_id")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    return held.withColumn("salt", F.pmod(F.xxhash64("stretch"), F.lit(salts))).join(asked.withColumn("salt", copies), ["repository_id", "salt"])


class _Stretch:
    """The blocks of a stretch that some queries ask for: bounds of its segments and weights of its chunks."""

    def __init__(self, row: dict, asked: lexical._Asked):
        at = {t: i for i, t in enumerate(asked.terms)}
        blocks = [b for b in row["blocks"] if b["term"] in at]
        code = np.array([at[b["term"]] for b in blocks], np.int64)
        self.held = np.unique(code)
        code = np.searchsorted(self.held, code)
        join = lambda name, kind: np.frombuffer(b"".join(b[name] for b in blocks), kind)
        largest = np.zeros((STRETCH_SEGMENTS, len(self.held)))
        sizes = [len(b["segments"]) for b in blocks]
        np.maximum.at(largest, (join("segments", np.uint8), np.repeat(code, sizes)), join("impacts", np.float32))
        self.largest, self.wanted = largest, asked.asked[self.held]
        self.bounds = largest @ self.wanted
        if not blocks or "hits" not in blocks[0]:
            return
        sizes = [len(b["hits"]) // 2 for b in blocks]
        counts = lambda name: np.concatenate([_counts(b[name], n) for b, n in zip(blocks, sizes)])
        place, weight = join("hits", np.uint16).astype(np.int64), counts("hit_names") * lexical.NAME_WEIGHT + counts("hit_bodies") * lexical.BODY_WEIGHT
        order = np.argsort(place, kind="stable")
        self.place, self.term, self.weight = place[order], np.repeat(code, sizes)[order], weight[order]
        self.at, first = np.unique(self.place, return_index=True)  # of the chunks with a hit
        self.lengths = counts("hit_lengths")[order][first]
        names = {c["place"]: c["chunk_id"] for c in row.get("chunks", [])}
        self.ids = [names[p] for p in self.at.tolist()] if names else []

    def weights(self, segment: int, segments: int) -> tuple[slice, np.ndarray]:
        """The chunks of some segments, and the weight of each held term in them."""
        low, high = segment * SEGMENT_CHUNKS, (segment + segments) * SEGMENT_CHUNKS
        hits, chunks = (slice(*np.searchsorted(places, [low, high])) for places in (self.place, self.at))
        row = np.searchsorted(self.at[chunks], self.place[hits])
        shape = (chunks.stop - chunks.start, len(self.held))
        return chunks, np.bincount(row * shape[1] + self.term[hits], self.weight[hits], shape[0] * shape[1]).reshape(shape)


def _each_stretch(run, fields: tuple[str, ...], types: list[pa.DataType]):
    """A function of batches that gives the rows of ``run(stretch, asked, row)`` for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("repository_id")[i].as_py(), batch.column("part")[i].as_py())
                if key not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[key] = lexical._Asked(batch.column("asked")[i].as_py())
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c not in ("asked", "part", "salt")}
                stretch = _Stretch(row, known[key])
                found = list(run(stretch, known[key], row)) if len(stretch.held) else []
                if found:
                    yield pa.record_batch({f: pa.array(c, t) for f, t, c in zip(fields, types, zip(*found))})

    return rows


def _query_type(searchable: DataFrame) -> tuple[str, pa.DataType]:
    kind = searchable.schema["query_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _bound_rows(stretch: _Stretch, asked: lexical._Asked, row: dict) -> Iterator[tuple]:
    for segment, q in np.argwhere(stretch.bounds > 0).tolist():
        yield asked.queries[q], row["repository_id"], (row["stretch"] << STRETCH_BITS) + segment, float(stretch.bounds[segment, q])


def segment_bounds(blocks: DataFrame, searchable: DataFrame) -> DataFrame:
    """(query_id, repository_id, segment, bound): no chunk of the segment ranks above the bound."""
    name, kind = _query_type(searchable)
    run = _each_stretch(_bound_rows, ("query_id", "repository_id", "segment", "bound"), [kind, pa.string(), pa.int64(), pa.float64()])
    pairs = _asked_stretches(blocks, searchable, HEADS).select("repository_id", "stretch", "part", "blocks", "asked")
    return pairs.mapInArrow(run, f"query_id {name}, repository_id string, segment bigint, bound double")


def _tried_rows(limit: int):
    def run(stretch: _Stretch, asked: lexical._Asked, row: dict) -> Iterator[tuple]:
        most = -(-limit // SEGMENT_CHUNKS) + 1
        for q, query in enumerate(asked.queries):
            first = np.argsort(-stretch.bounds[:, q], kind="stable")[:most]
            for segment in first[stretch.bounds[first, q] > 0].tolist():
                chunks, weights = stretch.weights(segment, 1)
                ranks = lexical.ranks_of(weights, stretch.wanted[:, [q]], stretch.lengths[chunks])[:, 0]
                yield from ((query, rank) for rank in ranks[ranks > 0].tolist())

    return run


def promising_segments(blocks: DataFrame, searchable: DataFrame, limit: int) -> DataFrame:
    """The (query, segment) rows that can hold one of the ``limit`` best chunks.

    The segments of a stretch with the largest bounds, as many as hold ``limit`` chunks if all are full
    and one more, are scored; a segment whose bound is below the ``limit``-th best of these ranks is skipped.
    """
    name, kind = _query_type(searchable)
    run = _each_stretch(_tried_rows(limit), ("query_id", "text_rank"), [kind, pa.float64()])
    pairs = _asked_stretches(blocks, searchable, HITS).select("repository_id", "stretch", "part", "blocks", "asked")
    ranks = pairs.mapInArrow(run, f"query_id {name}, text_rank double")
    best = Window.partitionBy("query_id").orderBy(F.desc("text_rank"))
    least = ranks.withColumn("n", F.row_number().over(best)).where(F.col("n") == limit).select("query_id", F.col("text_rank").alias("least"))
    bounds = segment_bounds(blocks, searchable).join(least, "query_id", "left")
    return bounds.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - ROOM)).select("query_id", "segment")


def _judged_rows(stretch: _Stretch, asked: lexical._Asked, row: dict) -> Iterator[tuple]:
    count, best = np.zeros(len(asked.queries), np.int64), np.full(len(asked.queries), -np.inf)
    for at in range(0, STRETCH_SEGMENTS, SCORED_SEGMENTS):
        chunks, weights = stretch.weights(at, SCORED_SEGMENTS)
        if not len(weights):
            continue
        ranks = lexical.ranks_of(weights, stretch.wanted, stretch.lengths[chunks])
        bound = stretch.bounds[stretch.at[chunks] >> SEGMENT_BITS]
        good = ((weights > 0).astype(np.float64) @ stretch.wanted > 0) & (ranks <= bound + ROOM)
        count += good.sum(axis=0)
        best = np.maximum(best, np.where(good, ranks, -np.inf).max(axis=0))
    for q in np.flatnonzero(count).tolist():
        yield asked.queries[q], int(count[q]), float(best[q])


def chunks_within_bounds(index: LexicalIndex, searchable: DataFrame) -> DataFrame:
    """(query_id, chunks, best): how many matching chunks rank within the bound of their segment, and their best rank.

    Every matching chunk is scored in the row of its stretch; a row per query leaves it.
    """
    name, kind = _query_type(searchable)
    run = _each_stretch(_judged_rows, ("query_id", "chunks", "best"), [kind, pa.int64(), pa.float64()])
    pairs = _asked_stretches(index.blocks, searchable, HITS, index.places).select("repository_id", "stretch", "part", "blocks", "chunks", "asked")
    rows = pairs.mapInArrow(run, f"query_id {name}, chunks bigint, best double")
    return rows.groupBy("query_id").agg(F.sum("chunks").alias("chunks"), F.max("best").alias("best"))


def _hit_rows(limit: int):
    def run(stretch: _Stretch, asked: lexical._Asked, row: dict) -> Iterator[tuple]:
        slices = stretch.bounds.reshape(-1, SCORED_SEGMENTS, len(asked.queries)).max(axis=1)
        for at in np.argsort(-slices.max(axis=1), kind="stable").tolist():
            least = np.array([b.min() - ROOM if len(b) == limit else 0.0 for b in asked.best])
            wanted = np.flatnonzero((slices[at] > 0) & (slices[at] >= least))
            if len(wanted):
                chunks, weights = stretch.weights(at * SCORED_SEGMENTS, SCORED_SEGMENTS)
                yield from lexical.best_hits(weights, stretch.held, stretch.lengths[chunks], stretch.ids[chunks], asked, limit, wanted)

    return run


def block_search(index: LexicalIndex, stats: DataFrame, query_term_rows: DataFrame, limit: int) -> DataFrame:
    """The rows of ``lexical.lexical_search``, from the blocks that can hold them."""
    searchable = lexical.searchable_terms(stats, query_term_rows).withColumn("bucket", term_bucket(F.col("term")))
    searchable = cut_lineage(searchable.select("bucket", "repository_id", "term", "query_id", "position", "idf"))
    blocks = in_folders(index.blocks, "bucket", searchable)
    name, kind = _query_type(searchable)
    pairs = _asked_stretches(blocks, searchable, HITS, index.places).select("repository_id", "stretch", "part", "blocks", "chunks", "asked")
    run = _each_stretch(_hit_rows(limit), lexical.HIT, [kind, pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())])
    hits = pairs.mapInArrow(run, lexical.hit_schema(name))
    best = Window.partitionBy("query_id").orderBy(F.desc("text_rank"), "chunk_id")
    top = hits.withColumn("text_position", F.row_number().over(best)).where(F.col("text_position") <= limit)
    return top.select("query_id", "chunk_id", "text_rank", "matched_idf", "text_position", "matched_terms")
