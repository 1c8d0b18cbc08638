"""Quantiles that can be merged, and exact ones with bounded state.

A day's values are kept as sketches, a few kilobytes for each group whatever the number of rows;
any span of days is answered by merging its sketches. Exact quantiles narrow a histogram: each pass
counts the values of a group in ``BUCKETS`` equal parts of the interval that still holds the wanted
rank, so a group's state is its buckets, combined before the shuffle, and never its values.

Defined results: null values are left out; a group without values has a null quantile; for an even
number of values the median is the mean of the two in the middle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

BUCKETS = 256
SKETCH_K = 400


def daily_sketches(rows: DataFrame, groups: Sequence[str], day: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """A sketch of a whole-number column per group and day, with the number of values."""
    return rows.where(F.col(value).isNotNull()).groupBy(*groups, day).agg(
        F.count(value).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch")
    )


def merged_quantile(sketches: DataFrame, groups: Sequence[str], rank: float = 0.5) -> DataFrame:
    """An estimate of a quantile per group over all the given sketches, and the number of values."""
    merged = sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("_sketch"))
    return merged.select(*groups, "n", F.kll_sketch_get_quantile_bigint("_sketch", F.lit(rank)).alias("quantile"))


def exact_median(rows: DataFrame, groups: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """groups, n, median (double) of a whole-number column.

    Two ranks per group are followed, the lower and the upper middle. The number of passes is the
    logarithm of the widest interval of values to the base ``buckets``.
    """
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    keys = [f"_g{i}" for i in range(len(groups))]
    values = cut_lineage(rows.select(*named, F.col(value).cast("decimal(38,0)").alias("_v")))
    held = values.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    sides = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    wanted = held.where("n > 0").select(*keys, "n", F.explode(sides).alias("rank"), "low", "high")
    wanted = wanted.withColumn("skip", F.col("rank"))  # values of the interval before the wanted one
    while True:
        wanted = cut_lineage(wanted)
        if not wanted.where("low < high").limit(1).count():
            break
        asked = wanted.where("low < high").withColumn("step", F.ceil((F.col("high") - F.col("low") + 1) / buckets).cast("decimal(38,0)"))
        w = asked.select(*(F.col(k).alias(f"w{k}") for k in keys), "rank", "low", "high", "step")
        met = values.join(w, [F.col(k).eqNullSafe(F.col(f"w{k}")) for k in keys] + [F.col("_v") >= F.col("low"), F.col("_v") <= F.col("high")])
        part = F.floor((F.col("_v") - F.col("low")) / F.col("step")).cast("int")
        counts = met.groupBy(*keys, "rank", part.alias("part")).agg(F.count("*").alias("c"))
        # At most `buckets` counts of a rank: their running sum finds the part that holds it.
        packed = counts.groupBy(*keys, "rank").agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("parts"))
        p = packed.select(*(F.col(k).alias(f"p{k}") for k in keys), F.col("rank").alias("p_rank"), "parts")
        found = wanted.join(p, [F.col(k).eqNullSafe(F.col(f"p{k}")) for k in keys] + [F.col("rank") == F.col("p_rank")], "left")
        state = "struct<left:bigint,part:int,found:boolean>"
        walked = F.aggregate(
            "parts",
            F.struct(F.col("skip").cast("bigint").alias("left"), F.lit(0).alias("part"), F.lit(False).alias("found")).cast(state),
            lambda s, b: F.when(s["found"], s)
            .when(s["left"] < b["c"], F.struct(s["left"].alias("left"), b["part"].alias("part"), F.lit(True).alias("found")))
            .otherwise(F.struct((s["left"] - b["c"]).alias("left"), b["part"].alias("part"), F.lit(False).alias("found")))
            .cast(state),
        )
        step = F.ceil((F.col("high") - F.col("low") + 1) / buckets).cast("decimal(38,0)")
        low = (F.col("low") + F.col("_w.part") * step).cast("decimal(38,0)")
        moved = found.withColumn("_w", F.when(F.col("parts").isNotNull(), walked))
        wanted = moved.select(
            *keys, "n", "rank",
            F.when(F.col("_w").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("_w").isNull(), F.col("high")).otherwise(F.least(F.col("high"), (low + step - 1).cast("decimal(38,0)"))).alias("high"),
            F.when(F.col("_w").isNull(), F.col("skip")).otherwise(F.col("_w.left")).alias("skip"),
        )
    medians = wanted.groupBy(*keys).agg(F.first("n").alias("n"), F.avg(F.col("low").cast("double")).alias("median"))
    whole = held.select(*keys, F.col("n").alias("_n"))
    joined = whole.join(medians.select(*(F.col(k).alias(f"m{k}") for k in keys), "median"), [F.col(k).eqNullSafe(F.col(f"m{k}")) for k in keys], "left")
    return joined.select(*(F.col(k).alias(g) for k, g in zip(keys, groups)), F.col("_n").alias("n"), "median")
