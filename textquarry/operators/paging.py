"""Pages of a total order from a stored rank directory.

The rows are written once in ranges of the order, each in a folder of its own, with a small table
of how many rows a range holds and where it begins. An offset then names the ranges it falls into,
and only their folders are read; a page deep in the order costs as much as the first one. A key,
as the last row of a page shows it, continues behind that page without counting at all.

Defined results: the order must be total (add a unique column last); nulls come where Spark puts
them for each direction; an offset beyond the last row gives no rows; rows of an empty table give
an empty directory; columns of the rows may have any name but those starting with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Order:
    """A column of an order and its direction."""

    column: str
    descending: bool = False

    def sort(self) -> Column:
        return F.desc(self.column) if self.descending else F.asc(self.column)

    def after(self, value: Column) -> Column:
        """Rows behind a value; nulls are least."""
        column = F.col(self.column)
        if self.descending:
            return F.coalesce(column < value, column.isNull() & value.isNotNull())
        return F.coalesce(column > value, column.isNotNull() & value.isNull())


def write_directory(df: DataFrame, order: Sequence[Order], path: str, range_rows: int = RANGE_ROWS, least_ranges: int = 8) -> None:
    """Write the rows by ranges of the order, and the ranks at which the ranges begin."""
    ranges = max(least_ranges, -(-df.count() // range_rows))
    keys = [o.sort() for o in order]
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    dealt.limit(0).write.parquet(f"{path}/schema")
    dealt.write.partitionBy("_range").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts.select("_range", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_rank")).write.parquet(f"{path}/ranges")


class Directory:
    """A stored directory. The table of ranges has a row for each ``RANGE_ROWS`` rows."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[Order]):
        self.rows = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")
        self.ranges = spark.read.parquet(f"{path}/ranges")
        self.order = list(order)

    def total(self) -> int:
        return int(self.ranges.agg(F.sum("rows")).first()[0] or 0)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """The rows at ranks ``offset`` to ``offset + limit``, with ``total_rows``; reads only their ranges."""
        end = F.col("first_rank") + F.col("rows")
        held = self.ranges.where((F.col("first_rank") < offset + limit) & (end > offset)).orderBy("first_rank").collect()
        some = self.rows.where(F.col("_range").isin([r["_range"] for r in held]) if held else F.lit(False))
        skipped = offset - held[0]["first_rank"] if held else 0
        ordered = some.orderBy(*(o.sort() for o in self.order)).offset(skipped).limit(limit)
        return ordered.drop("_range").withColumn("total_rows", F.lit(self.total()).cast("bigint"))

    def after(self, key: Sequence, limit: int) -> DataFrame:
        """The next rows behind a key (a value for each column of the order)."""
        kinds = self.rows.schema
        values = [F.lit(v).cast(kinds[o.column].dataType) for o, v in zip(self.order, key)]
        behind, equal = F.lit(False), F.lit(True)
        for o, value in zip(self.order, values):
            behind = behind | (equal & o.after(value))
            equal = equal & F.col(o.column).eqNullSafe(value)
        # Statistics of files and the ordered limit keep this to the ranges that follow the key.
        return self.rows.where(behind).orderBy(*(o.sort() for o in self.order)).limit(limit).drop("_range")
