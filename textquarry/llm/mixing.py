"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of `block_words`. Each output shard draws
how many of its slots every source gets (whole expected slots are granted, the remainders are
drawn from a multinomial), the slots of a source walk through a pseudorandom permutation of its
block indexes, and the drawn blocks are joined with the documents they cover by index.

Everything is a function of the data and `seed`, so reruns agree. Only DataFrame functions.

Defined results: null or empty text has size 0 and takes nothing; a null source is a source of its
own that sorts last; repeated rows are separate documents; an empty table gives an empty result;
extra columns pass through `mix` only by the columns it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

LIMIT = 3
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): shares by weight of all words, no source above `limit` times its own.

    `sizes`: source, source_size. The table has a row per source and is written before each round
    of resharing; in every round but the last at least one source stops at its limit.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    left = cut_lineage(sizes.select("source", "source_size", weight.cast("double").alias("weight")))
    total = left.agg(F.sum("source_size")).first()[0] or 0
    done = None
    free = float(total)
    while True:
        weighed = left.agg(F.sum("weight")).first()[0]
        if not weighed:
            break
        share = F.lit(free) * F.col("weight") / F.lit(weighed)
        full = left.filter(share >= limit * F.col("source_size"))
        stopped = full.agg(F.count("*"), F.sum("source_size")).first()
        if not stopped[0]:
            rest = left.select("source", "source_size", share.alias("target"))
            done = rest if done is None else done.unionByName(rest)
            break
        at_limit = full.select("source", "source_size", (limit * F.col("source_size")).cast("double").alias("target"))
        done = at_limit if done is None else done.unionByName(at_limit)
        left = cut_lineage(left.filter(share < limit * F.col("source_size")))
        free -= limit * float(stopped[1])
    return cut_lineage(done if done is not None else left.select("source", "source_size", F.lit(0.0).alias("target")))


def permuted(rows: DataFrame, index: str, key: Column, size: str, seed: int, rounds: int = 8) -> DataFrame:
    """Replaces `index` by its place in a keyed pseudorandom permutation of 0..size-1 (swap or not)."""
    rows = rows.withColumn("_key", F.xxhash64(key, F.lit(seed))).withColumn(index, F.col(index).cast("bigint"))
    for r in range(rounds):
        turned = F.pmod(F.pmod(F.xxhash64("_key", F.lit(r)), F.col(size)) + F.col(size) - F.col(index), F.col(size))
        rows = rows.withColumn("_other", turned)
        stays = F.pmod(F.xxhash64("_key", F.lit(~r), F.greatest(index, "_other")), F.lit(2)) == 0
        rows = rows.withColumn(index, F.when(stays, F.col(index)).otherwise(F.col("_other")))
    return rows.drop("_key", "_other")


def place(documents: DataFrame, key: str, per_bucket: int = 2_000) -> DataFrame:
    """Adds the first word's index in the stream of its source, `start`, without a task per source.

    Documents of a source are dealt to buckets by hash; running sums go over the buckets of a
    source (a small table) and then within each bucket. Repeated rows keep places of their own.
    """
    buckets = max(1, -(-documents.count() // per_bucket))
    dealt = documents.withColumn("bucket", F.pmod(F.xxhash64(key, "size"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")
    )
    own = Window.partitionBy("source", "bucket").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("start", (F.col("base") + F.col("inner")).cast("bigint"))
        .drop("bucket", "inner", "base", "s", "b")
    )


def draw_blocks(
    targets: DataFrame, block_words: int, shard_slots: int = 65_536, slice_slots: int = 8192, limit: int = LIMIT, seed: int = 11
) -> DataFrame:
    """(source, shard, slot, block): the block that fills each slot of a source in each shard."""
    sized = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("bigint"))
    sized = sized.withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))
    # Slots follow the mean length of the source's own blocks, so a short last block biases nothing.
    sized = sized.withColumn("whole", F.floor("slots").cast("bigint")).withColumn("part", F.col("slots") - F.floor("slots"))
    order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    sized = cut_lineage(sized.withColumn("part_to", F.sum("part").over(order)))
    whole, parts = sized.agg(F.coalesce(F.sum("whole"), F.lit(0)), F.coalesce(F.max("part_to"), F.lit(0.0))).first()
    spare = int(round(parts))
    shards = max(1, -(-(whole + spare) // shard_slots))
    point = lambda j: F.pmod(F.xxhash64(j, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * parts
    low = F.col("part_to") - F.col("part")
    draws = F.filter(
        F.sequence(F.lit(0), F.lit(spare - 1)) if spare else F.array().cast("array<int>"),
        lambda j: (F.pmod(j, F.lit(shards)) == F.col("shard")) & (point(j) >= low) & (point(j) < F.col("part_to")),
    )
    counted = sized.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))).withColumn(
        "granted",
        F.floor((F.col("shard") + 1) * F.col("whole") / shards) - F.floor(F.col("shard") * F.col("whole") / shards) + F.size(draws),
    )
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    # No block is used more than `limit` times, whatever the draws gave.
    last = F.least(F.sum("granted").over(upto), limit * F.col("blocks"))
    ranged = counted.withColumn("last", last.cast("bigint"))
    first = F.coalesce(F.lag("last").over(Window.partitionBy("source").orderBy("shard")), F.lit(0))
    ranged = ranged.withColumn("first", first).filter(F.col("last") > F.col("first"))
    # A range of slots is cut before it is unfolded, so that a large source is spread over tasks.
    steps = F.sequence(F.col("first"), F.col("last") - 1, F.lit(slice_slots))
    cut = ranged.select("source", "blocks", "shard", "last", F.explode(steps).alias("from")).repartition("source", "from")
    upto_slot = F.least(F.col("from") + slice_slots, F.col("last")) - 1
    slots = cut.select("source", "blocks", "shard", F.explode(F.sequence(F.col("from"), upto_slot)).alias("slot"))
    key = F.struct(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.floor(F.col("slot") / F.col("blocks")))
    numbered = slots.withColumn("block", F.col("slot") % F.col("blocks"))
    return permuted(numbered, "block", key, "blocks", seed).select("source", "shard", "slot", "block")


def mix(documents: DataFrame, key: str = "doc_id", block_words: int = 32, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """Rows (key, source, size, source_size, target, start, taken, parts) of every document.

    `documents`: key, source, size. `parts` lists the document's blocks in order as
    (first word within the document, number of words, times taken).
    """
    sized = cut_lineage(documents.select(key, "source", F.col("size").cast("bigint").alias("size")))  # reads the texts once
    placed = cut_lineage(place(sized, key))
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    # Written, so that no condition on the join's key is rewritten in terms of every round.
    drawn = cut_lineage(draw_blocks(targets, block_words, seed=seed).groupBy("source", "block").agg(F.count("*").alias("times")))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    from_ = F.greatest(F.col("start"), F.col("block") * block_words)
    to = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.withColumn("at", from_ - F.col("start")).withColumn("words", to - from_)
    drawn = drawn.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    taken = (
        pieces.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .groupBy("source", "start")
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("parts"))
        .select(F.col("source").alias("s"), F.col("start").alias("p"), "taken", "parts")
    )
    full = placed.join(
        taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("p")) & (F.col("size") > 0), "left"
    ).drop("s", "p")
    targets = targets.withColumnRenamed("source", "s")
    return full.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").select(
        key, "source", "size", "source_size", "target", "start", F.coalesce("taken", F.lit(0)).alias("taken"), "parts"
    )


def word_count(text: Column) -> Column:
    """The number of words: of the spaces that precede one, when every gap is a single space."""
    for gap in "\n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(gap), F.lit(" "))
    text = F.concat(F.lit(" "), text)
    text = F.rtrim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text))
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(0)).cast("bigint")
