"""A Spark data source over folders of files, for stores that Arrow's file systems reach.

    spark.dataSource.register(CorpusFiles)
    spark.read.format("corpus_files").load("/data/corpus")

Rows: path (below the root), part, parts, offset, size (of the file), content, skip_reason. A file larger than
``part_bytes`` comes in parts, so a row stays small whatever the file's size. The driver lists
folders only, down to the level that has enough of them for ``tasks``; files are listed by the task
that reads them. Filters on path and size are taken into the listing, so files that they refuse are
not opened. An item that can't be read keeps its row, without content and with skip_reason
'unreadable'. Contents go straight to the plan that asks for them; nothing is copied.

Options: ``glob`` (of file names), ``part_bytes``, ``tasks``, ``contents`` (false lists only).
Defined results: an empty file is one empty part; an empty or missing folder gives no rows; files
whose names begin with a dot or an underscore are read like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

SCHEMA = "path string, part int, parts int, offset bigint, size bigint, content binary, skip_reason string"
KINDS = pa.schema(
    [("path", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("skip_reason", pa.string())]
)
PART_BYTES = 64 << 20
BATCH_BYTES = 16 << 20
FILTER_CONF = "spark.sql.python.filterPushdown.enabled"
COMPARES = {
    EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
}


@dataclass
class Folder(InputPartition):
    """A folder to list; without its subfolders where those are partitions of their own."""

    path: str
    deep: bool


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (fs.LocalFileSystem(), root)


class _Reader(DataSourceReader):
    def __init__(self, root: str, glob: str | None, part_bytes: int, tasks: int, contents: bool):
        self.root, self.glob, self.part_bytes, self.tasks, self.contents = root, glob, part_bytes, tasks, contents
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if type(one) in COMPARES and one.attribute in (("size",), ("path",)):
                self.tests.append((type(one).__name__, one.attribute[0], one.value))
            elif isinstance(one, StringStartsWith) and one.attribute == ("path",):
                self.tests.append(("StringStartsWith", "path", one.value))
            else:
                yield one

    def _wanted(self, path: str, size: int) -> bool:
        named = {kind.__name__: test for kind, test in COMPARES.items()} | {"StringStartsWith": str.startswith}
        held = {"path": path, "size": size}
        return all(named[kind](held[column], value) for kind, column, value in self.tests)

    def partitions(self) -> list[Folder]:
        store, base = _open(self.root)
        if store.get_file_info(base).type != fs.FileType.Directory:
            return [Folder(base, True)]
        shallow, level = [], [base]
        while len(level) < self.tasks:
            below = [i.path for f in level for i in store.get_file_info(fs.FileSelector(f)) if i.type == fs.FileType.Directory]
            if not below:
                break
            shallow += level
            level = below
        return [Folder(f, False) for f in shallow] + [Folder(f, True) for f in level]

    def _files(self, store: fs.FileSystem, folder: Folder, base: str) -> Iterator[tuple[str, str, int | None]]:
        try:
            items = store.get_file_info(fs.FileSelector(folder.path, recursive=folder.deep, allow_not_found=True))
        except OSError:  # the folder keeps a row
            yield folder.path, folder.path[len(base) :].lstrip("/"), None
            return
        for item in items:
            path = item.path[len(base) :].lstrip("/")
            if item.type == fs.FileType.File and (not self.glob or fnmatchcase(item.base_name, self.glob)) and self._wanted(path, item.size):
                yield item.path, path, item.size

    def _parts(self, store: fs.FileSystem, place: str, path: str, size: int) -> Iterator[tuple]:
        if size is None:
            yield path, 0, 1, 0, None, None, "unreadable"
            return
        parts = max(1, -(-size // self.part_bytes))
        if not self.contents:
            yield path, 0, parts, 0, size, None, None
            return
        sent = 0
        try:
            with store.open_input_file(place) as source:
                for part in range(parts):
                    at = part * self.part_bytes
                    data = source.read_at(min(self.part_bytes, size - at), at)
                    if len(data) < min(self.part_bytes, size - at):
                        raise OSError("the file ends early")
                    yield path, part, parts, at, size, data, None
                    sent += 1
        except OSError:
            yield path, sent, parts, sent * self.part_bytes, size, None, "unreadable"

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, base = _open(self.root)
        rows, held = [], 0
        for place, path, size in self._files(store, partition, base.rstrip("/")):
            for row in self._parts(store, place, path, size):
                rows.append(row)
                held += len(row[5] or b"") + 200
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), KINDS)], schema=KINDS)


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        o = self.options
        return _Reader(
            o["path"], o.get("glob"), int(o.get("part_bytes", PART_BYTES)), int(o.get("tasks", 64)), o.get("contents", "true").lower() != "false"
        )


def read_corpus(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files below a root; options as above."""
    spark.dataSource.register(CorpusFiles)
    spark.conf.set(FILTER_CONF, "true")
    return spark.read.format("corpus_files").options(**{k: str(v) for k, v in options.items()}).load(root)


def corpus_manifest(spark: SparkSession, root: str, repository_id: str, max_part_bytes: int = PART_BYTES, **options) -> DataFrame:
    """The columns of ``files.scan_files`` for files of one part; larger ones are named without content.

    They keep their row, with skip_reason 'in_parts', and are read from ``read_corpus``.
    """
    found = read_corpus(spark, root, part_bytes=max_part_bytes, **options).where("part = 0")
    whole = (F.col("parts") == 1) & F.col("skip_reason").isNull()
    content = F.when(whole, F.col("content"))
    return found.select(
        F.lit(repository_id).alias("repository_id"), "path", F.sha1(content).alias("sha"), F.lit("blob").alias("type"), "size",
        content.alias("content"), F.coalesce("skip_reason", F.when(F.col("parts") > 1, "in_parts")).alias("skip_reason"),
    )
