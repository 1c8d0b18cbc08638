"""Exact top-k search by inner product with the threshold algorithm.

Vectors are dealt to shards by hash; a shard is one row that holds its integer vectors. Within a
shard every dimension gives a list sorted by value. A query reads the lists of its non-zero
dimensions from their better end in growing steps, scores each vector when it is first seen, and
stops when the best score any unseen vector could have is below the kth best. The k best of each
shard are then merged. Queries come in blocks.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part;
only vectors of one length are compared; ties go to the smaller id; repeated ids are repeated
rows; with fewer than k candidates all are returned; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null unless all are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def pack(vectors: DataFrame, group: Column, group_name: str) -> DataFrame:
    """One row per group and vector length: ids and components, side by side."""
    return (
        vectors.withColumn(group_name, group)
        .groupBy(group_name, F.size("vector").alias("width"))
        .agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
        .select(group_name, "width", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("values"))
    )


def threshold_search(matrix: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int):
    """The k best (row, score) of one shard for one query, by score, then smaller id."""
    count = len(matrix)
    used = np.flatnonzero(query)
    if not len(used):  # every score is 0
        rows = np.argsort(ids, kind="stable")
        rows = rows[ids[rows] != own][:k]
        return rows, np.zeros(len(rows), np.int64)
    # lists[d] ascends; a positive weight reads it from the end, a negative one from the start
    ends = np.where(query[used] > 0, 1, 0)
    seen = np.zeros(count, bool)
    best_rows, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step = 0, 16
    while depth < count:
        until = min(count, depth + step)
        read = np.where(ends[:, None] == 1, lists[used, count - until : count - depth][:, ::-1], lists[used, depth:until])
        new = np.unique(read)
        new = new[~seen[new]]
        seen[new] = True
        new = new[ids[new] != own]
        rows = np.concatenate([best_rows, new])
        scores = np.concatenate([best_scores, matrix[new] @ query])
        keep = np.lexsort((ids[rows], -scores))[:k]
        best_rows, best_scores = rows[keep], scores[keep]
        bound = int((matrix[read[:, -1], used] * query[used]).sum())
        depth, step = until, step * 2
        if len(best_rows) == k and bound < best_scores[-1]:  # at equality a smaller id may still come
            break
    return best_rows, best_scores


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                width = row["width"].as_py()
                ids = np.asarray(row["ids"].values.to_numpy(zero_copy_only=False), np.int64)
                matrix = np.asarray(row["values"].values.to_numpy(zero_copy_only=False), np.int64).reshape(len(ids), width)
                lists = np.argsort(matrix, axis=0, kind="stable").T.copy()
                asked = np.asarray(row["query_ids"].values.to_numpy(zero_copy_only=False), np.int64)
                wanted = np.asarray(row["query_values"].values.to_numpy(zero_copy_only=False), np.int64).reshape(len(asked), width)
                found = [threshold_search(matrix, ids, lists, q, own, k) for own, q in zip(asked, wanted)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(asked, [len(r) for r, _ in found])),
                        pa.array(np.concatenate([ids[r] for r, _ in found] or [ids[:0]])),
                        pa.array(np.concatenate([s for _, s in found] or [ids[:0]]).astype(np.int64)),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 4096, query_rows: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query.

    Both tables: id, vector (array of bigint).
    """
    spark = vectors.sparkSession
    vectors, queries = (t.select("id", "vector").filter("vector IS NOT NULL") for t in (vectors, queries))
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    stored = pack(vectors, F.pmod(F.xxhash64("id", "vector"), F.lit(shards)), "shard")
    asked = pack(queries, F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)), "block").select(
        F.col("block"), F.col("width").alias("query_width"), F.col("ids").alias("query_ids"), F.col("values").alias("query_values")
    )
    # The stated query set meets every shard, block by block.
    pairs = stored.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
        asked, (F.col("at") == F.col("block")) & (F.col("width") == F.col("query_width"))
    )
    schema = "query_id bigint, vec_id bigint, score bigint"
    parallel = max(shards * blocks, spark.sparkContext.defaultParallelism)
    found = pairs.select("width", "ids", "values", "query_ids", "query_values").repartition(min(parallel, 4096)).mapInArrow(_search(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
