"""Session defaults for local runs; a cluster brings its own settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, local)
    return local


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written herein go when it is written, not when the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_CUT: ContextVar[list[str] | None] = ContextVar("cut", default=None)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def tables_dropped(spark: SparkSession):
    """Tables that ``cut_lineage`` writes herein go at the end; nothing that reads them may leave."""
    held = _CUT.set([])
    try:
        yield
    finally:
        for path in _CUT.get():
            drop_folder(spark, path)
        _CUT.reset(held)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to a new table in the shared folder and read it back.

    Later stages then survive a lost executor, and the planner knows the table's size, which a
    checkpointed RDD would hide: it picks the small side of a join by it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    if _CUT.get() is not None:
        _CUT.get().append(path)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

