"""Corpus readers and adapters: manifests, blobs, files and messages."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import cut_lineage

MAX_TREE_DEPTH = 300


def scan_files(
    spark: SparkSession, root: str, repository_id: str, glob: str | None = None
) -> DataFrame:
    """Manifest and raw bytes below a folder; an item that can't be read is a row without content.

    Every listed file has one row. What the reader skips (a failed or vanished file) comes back with
    skip_reason 'unreadable' and, if it is still there, its size. Contents are read once, into the
    shared folder.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # The root as the reader names it: scheme and all, cut off once from the front.
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(folder).toString().rstrip("/") + "/"
    path = F.col("path")
    found = reader.load(root)
    listed = [(unquote(name).replace(":///", ":/", 1),) for name in found.inputFiles()]
    read = cut_lineage(found.select("path", "length", "content"))
    lost = spark.createDataFrame(listed, "path string").join(read.select("path"), "path", "left_anti")
    lost = lost.join(found.select("path", "length"), "path", "left")
    rows = read.withColumn("skip_reason", F.lit(None).cast("string")).unionByName(
        lost.select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("unreadable").alias("skip_reason"))
    )
    return rows.select(
        F.lit(repository_id).alias("repository_id"),
        F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("path"),
        F.sha1("content").alias("sha"),
        F.lit("blob").alias("type"),
        F.col("length").alias("size"),
        "content",
        "skip_reason",
    )


def rebuild_paths(tree_nodes: DataFrame, max_depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """Full blob paths from (repository_id, parent_sha, name, sha, type) rows; roots have no parent.

    A level-by-level join: the number of jobs follows the depth of the trees, not their size.
    Submodules are dropped. A tree deeper than the limit raises rather than being cut.
    """
    nodes = tree_nodes.where(F.col("type") != "commit")
    columns = ["repository_id", "path", "sha", "type"]
    level = nodes.where(F.col("parent_sha").isNull()).select(
        "repository_id", F.col("name").alias("path"), "sha", "type"
    )
    blobs = []
    children = nodes.where(F.col("parent_sha").isNotNull()).select(
        "repository_id", F.col("parent_sha").alias("tree_sha"), "name",
        F.col("sha").alias("child_sha"), F.col("type").alias("child_type"),
    )
    for _ in range(max_depth):
        level = cut_lineage(level)
        blobs.append(level.where(F.col("type") == "blob"))
        trees = level.where(F.col("type") == "tree").select(
            "repository_id", F.col("sha").alias("tree_sha"), "path"
        )
        if trees.isEmpty():
            out = blobs[0]
            for part in blobs[1:]:
                out = out.unionByName(part)
            return out.select(*columns)
        level = trees.join(children, ["repository_id", "tree_sha"]).select(
            "repository_id",
            F.concat_ws("/", "path", "name").alias("path"),
            F.col("child_sha").alias("sha"),
            F.col("child_type").alias("type"),
        )
    raise ValueError(f"tree is deeper than {max_depth} levels; the listing would be partial")


def attach_content(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Join blob bytes by sha; an absent or undecodable blob becomes ``decode_failed``.

    ``blobs`` holds (sha, encoding, payload) with payload base64 or plain text.
    """
    data = blobs.select(
        "sha",
        F.when(F.col("encoding") == "base64", F.try_to_binary("payload", F.lit("base64")))
        .otherwise(F.encode("payload", "UTF-8"))
        .alias("content"),
    )
    return manifest.join(data, "sha", "left").withColumn(
        "skip_reason", F.when(F.col("content").isNull(), F.lit("decode_failed"))
    )


def documents_as_files(
    documents: DataFrame, repository: Column | None = None, suffix: str = ".txt"
) -> DataFrame:
    return documents.select(
        (F.col("source") if repository is None else repository).alias("repository_id"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"),
        F.sha2("text", 256).alias("sha"),
        F.lit("blob").alias("type"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("doc_id").alias("pos"),
        F.col("text").alias("content"),
    )


def pages_as_files(pages: DataFrame) -> DataFrame:
    """One repository per host; the path keeps the page id, so it is unique."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return pages.select(
        host.alias("repository_id"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.sha2("html", 256).alias("sha"),
        F.lit("blob").alias("type"),
        F.octet_length("html").cast("bigint").alias("size"),
        F.col("page_id").alias("pos"),
        F.col("html").alias("content"),
    )


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    """Turns as messages; creation time is one minute per turn from a fixed start."""
    return conversations.select(
        F.col("conv_id").alias("conversation_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        "role",
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60).alias("created_at"),
        "turn",
    )
