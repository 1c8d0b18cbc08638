"""Writers that publish corpus tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import shuffles_dropped


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_run(df: DataFrame, path: str, run: str, folders: Sequence[str] = ()) -> DataFrame:
    """Write the rows of one run to a table; they stay unseen until the run is published.

    Writing a run again replaces its rows, so a repeated attempt is harmless. The rows of a run lie
    in ``folders`` by these columns, so that a search reads only those it asks for.
    """
    # The folder of the run is named here: a column for it would have every row sorted by it once more.
    rows = df.write.mode("overwrite").option("compression", "zstd")
    with shuffles_dropped(df.sparkSession):
        rows.partitionBy(*folders).parquet(f"{path}/run={run}")
    df.withColumn("run", F.lit(run)).limit(0).write.mode("ignore").parquet(f"{path}/_schema")
    written = df.sparkSession.read.schema(df.schema.add("run", "string")).parquet(path)
    return written.where(F.col("run") == run).drop("run")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table of runs, with their run; also of one that holds no rows yet."""
    return spark.read.schema(spark.read.parquet(f"{path}/_schema").schema).parquet(path)


def in_folders(table: DataFrame, folder: str, asked: DataFrame) -> DataFrame:
    """The rows of the folders that ``asked`` names; others are not listed for reading.

    A small table without a filter prunes no partitions by itself, so the folder numbers, of which
    there are as many as folders at most, are named in the plan.
    """
    return table.where(folders_asked(folder, asked))


def folders_asked(folder: str, asked: DataFrame) -> Column:
    """If a row lies in one of the folders that ``asked`` names."""
    names = [r[0] for r in asked.select(folder).distinct().collect()]
    return F.col(folder).isin(names) if names else F.lit(False)


def publish_run(
    keys: DataFrame, path: str, run: str, key: str | list[str] = "repository_id", order: Column | None = None
) -> None:
    """Make a run the current one of the given keys, in one append: all of it is seen, or nothing.

    The run with the greatest ``order`` is current, by default the one published last.
    """
    at = F.lit(time.time_ns()) if order is None else order
    rows = keys.select(*_keys(key), at.cast("bigint").alias("at")).groupBy(*_keys(key)).agg(F.max("at").alias("at"))
    with shuffles_dropped(keys.sparkSession):
        rows.withColumn("run", F.lit(run)).withColumn("covers", F.lit(None).cast("array<string>")).write.mode("append").parquet(path)


def publish_merge(runs: DataFrame, path: str, run: str, key: str | list[str] = "repository_id") -> None:
    """Make ``run`` current wherever one of the merged ``runs`` is, and name those it covers, in one append.

    A key keeps its order, so a version that comes late stays unseen; among equals the merged run
    is current, since its name is greater. Only the names of runs are gathered.
    """
    rows = runs.where(F.col(_keys(key)[0]).isNotNull()).groupBy(*_keys(key)).agg(F.max("at").alias("at"))
    names = runs.where("run IS NOT NULL").agg(F.collect_set("run").alias("covers")).withColumn("run", F.lit(run))
    rows = rows.withColumn("run", F.lit(run)).withColumn("covers", F.lit(None).cast("array<string>"))
    with shuffles_dropped(runs.sparkSession):
        rows.unionByName(names, allowMissingColumns=True).write.mode("append").parquet(path)


def live_runs(runs: DataFrame) -> DataFrame:
    """The published runs that no merged run covers: those whose additive rows count."""
    covered = runs.where("covers IS NOT NULL").select(F.explode("covers").alias("run"))
    return runs.select("run").distinct().join(covered, "run", "left_anti")


def current_runs(runs: DataFrame, key: str | list[str] = "repository_id") -> DataFrame:
    named = runs.where(F.col(_keys(key)[0]).isNotNull())
    return named.groupBy(*_keys(key)).agg(F.max_by("run", F.struct("at", "run")).alias("run"))


def current_rows(table: DataFrame, runs: DataFrame, key: str | list[str] = "repository_id") -> DataFrame:
    """The rows of each key's current run."""
    return table.join(current_runs(runs, key), [*_keys(key), "run"], "left_semi").drop("run")


def of_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have one of the keys, of which there are nearly as many as rows, each with few rows.

    Only the keys are held, so wide rows are not sorted for it.
    """
    return rows.join(keys.hint("shuffle_hash"), on, "left_semi")


def replace_snapshot(df: DataFrame, path: str, key: str = "repository_id", replaced: DataFrame | None = None) -> None:
    """Replace the rows of the ``replaced`` keys, by default those present in ``df``.

    A key that is replaced and has no rows in ``df`` has none afterwards; others stay untouched.
    Readers see the old rows until the last write, so a failed run changes nothing for them.
    """
    run = uuid.uuid4().hex
    written = write_run(df, f"{path}/data", run)
    publish_run(written if replaced is None else replaced, f"{path}/runs", run, key)


def read_snapshot(spark: SparkSession, path: str, key: str = "repository_id") -> DataFrame:
    return current_rows(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/runs"), key)


def append_events(df: DataFrame, path: str) -> None:
    """Add rows to an audit trail; nothing already written is changed."""
    df.write.mode("append").parquet(path)


def upsert(
    base: DataFrame, updates: DataFrame, keys: list[str], order: str
) -> DataFrame:
    """Insert or refresh by key: the newest update wins, columns it does not carry are kept.

    The newest update per key is an aggregate with map-side combine, so a key with very many
    updates never meets in one task whole.
    """
    values = [c for c in updates.columns if c not in keys and c != order]
    newest = (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col(order)).alias("_new"))
        .withColumn("_updated", F.lit(True))
    )
    joined = base.join(newest, keys, "full_outer")
    out = []
    for column in base.columns:
        if column in values:
            out.append(
                F.when(F.col("_updated"), F.coalesce(F.col(f"_new.{column}"), F.col(column)))
                .otherwise(F.col(column))
                .alias(column)
            )
        else:
            out.append(F.col(column))
    return joined.select(*out)

