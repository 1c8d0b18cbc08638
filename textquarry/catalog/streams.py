"""Sinks and streams: files written or streamed from the tables, read back as results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textquarry.catalog import lexical_sql
from textquarry.catalog.base import CHUNK_LIMITS, CHUNKS_SQL, FILES_SQL, document_files, query, table, with_ctes
from textquarry.plans import index as plan
from textquarry.session import checkpoint_dir, drop_folder, shuffles_dropped
from textquarry.sources import files as source_files
from textquarry.sources import sinks
from textquarry.streaming import jobs


def fresh(spark, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: So many texts at most lie in a line file, which is read whole.
LINES_PER_FILE = 2_000


@query(
    "scan_files",
    """SELECT lang, count(*) AS files, sum(strlen(text) + 1)::BIGINT AS bytes, count(DISTINCT text) AS blobs FROM documents GROUP BY lang""",
)
def scan_files(spark, sf_dir):
    """The documents written out as line files per language and read back as raw bytes.

    A language names its folder in hex, so that any name fits. A line tells a null text from an empty one, and line
    ends and the backslashes that escape them can be told apart, so every text comes back as it was. A
    file that can't be read fails the query: its documents would be missing in the counts.
    """
    path = fresh(spark, "corpus")
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))
    named = F.coalesce(F.concat(F.lit("x"), F.hex(F.encode("lang", "UTF-8"))), F.lit("none"))
    flat = table(spark, sf_dir, "documents").repartition("doc_id").select(
        named.alias("lang"), F.coalesce(F.concat(F.lit("+"), escaped), F.lit("-")).alias("value")
    )
    flat.write.partitionBy("lang").option("maxRecordsPerFile", LINES_PER_FILE).text(path)
    found = source_files.scan_files(spark, path, "corpus", "*.txt")
    read = F.when(F.col("skip_reason").isNull(), F.col("content").cast("string")).otherwise(F.raise_error(F.concat_ws(": ", "skip_reason", "path")))
    rows = found.select(F.regexp_extract("path", "^lang=([^/]*)/", 1).alias("named"), F.explode(F.split(read, "\n")).alias("line"))
    lang = F.when(F.startswith("named", F.lit("x")), F.unhex(F.substr("named", F.lit(2))).cast("string"))
    whole = F.replace(F.replace(F.substr("line", F.lit(2)), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
    text = F.when(F.startswith("line", F.lit("+")), whole)
    return rows.where("line <> ''").select(lang.alias("lang"), text.alias("text")).groupBy("lang").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text") + 1).alias("bytes"), F.count_distinct("text").alias("blobs")
    )


@query(
    "replace_snapshot",
    """SELECT source AS repository_id, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'second' ELSE 'first' END AS run, count(*) AS files
       FROM documents WHERE substr(source, 4)::INT % 2 = 1 OR (lang = 'en' AND substr(source, 4)::INT % 4 = 0) GROUP BY ALL""",
)
def replace_snapshot(spark, sf_dir):
    """All repositories are written, then the even ones again: with English files only, or emptied."""
    path = fresh(spark, "snapshot")
    files = document_files(spark, sf_dir).select("repository_id", "path")
    sinks.replace_snapshot(files.withColumn("state", F.lit("first")), path)
    even = F.substr("repository_id", F.lit(4)).cast("int") % 2 == 0
    fourth = F.substr("repository_id", F.lit(4)).cast("int") % 4 == 0
    again = files.where(fourth & F.col("path").startswith("en/")).withColumn("state", F.lit("second"))
    sinks.replace_snapshot(again, path, replaced=files.where(even))
    return sinks.read_snapshot(spark, path).groupBy("repository_id", F.col("state").alias("run")).agg(F.count("*").alias("files"))


@query(
    "publish_index_twice",
    with_ctes(
        FILES_SQL,
        """kept_first AS (SELECT repository_id, sha, max(pos) AS pos FROM files WHERE size > 0 AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY ALL),
kept_again AS (SELECT repository_id, sha, max(pos) AS pos FROM files WHERE size > 0 AND path LIKE 'en/%' AND substr(repository_id, 4)::INT % 3 = 2
  AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY ALL),
now AS (
  SELECT repository_id, pos, false AS again FROM kept_first WHERE substr(repository_id, 4)::INT % 3 = 0
  UNION ALL SELECT repository_id, pos, true FROM kept_again)""",
        select="""SELECT repository_id, count(*) AS files, count(*) FILTER (WHERE again AND EXISTS (SELECT 1 FROM kept_first f WHERE f.repository_id = now.repository_id AND f.pos = now.pos)) AS files_reused
                  FROM now GROUP BY repository_id""",
    ),
)
def publish_index_twice(spark, sf_dir):
    """An index of all repositories; then one in three becomes empty and one keeps its English files."""
    path = fresh(spark, "published")
    files = document_files(spark, sf_dir).drop("language", "content_type", "parseable", "blob_sha")
    plan.publish_index(plan.build_index(files, CHUNK_LIMITS), path)
    number = F.substr("repository_id", F.lit(4)).cast("int") % 3
    again = files.where((number == 2) & F.col("path").startswith("en/"))
    plan.publish_index(plan.build_index(again, CHUNK_LIMITS), path, plan.load_index(spark, path), replaced=files.where(number != 0))
    stored = plan.load_index(spark, path)
    parts = stored.chunks.select("repository_id", "path", "chunk_id").join(
        stored.embeddings.select("repository_id", "chunk_id", "reused"), ["repository_id", "chunk_id"]
    )
    per_file = parts.groupBy("repository_id", "path").agg(F.bool_and("reused").alias("reused"))
    return per_file.groupBy("repository_id").agg(F.count("*").alias("files"), F.count_if("reused").alias("files_reused"))


@query(
    "append_events",
    """SELECT event_type AS event, count(*) * 2 AS entries, count(DISTINCT event_id) AS events FROM events GROUP BY event_type""",
)
def append_events(spark, sf_dir):
    path = fresh(spark, "events")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("ts").alias("at"), "event_id")
    sinks.append_events(rows, path)
    sinks.append_events(rows, path)
    return spark.read.parquet(path).groupBy("event").agg(
        F.count("*").alias("entries"), F.count_distinct("event_id").alias("events")
    )


_STREAMED: dict[tuple[str, str], str] = {}


def streamed(spark, sf_dir) -> str:
    """The folder of a streamed index, after three deliveries: an older version of all documents, the
    current one, and at last every seventh document emptied while an outdated version of others comes late."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STREAMED:
        return _STREAMED[key]
    source, target = fresh(spark, "incoming"), fresh(spark, "live-index")
    now = document_files(spark, sf_dir).select("repository_id", "path", "sha", "type", "size", "content", "pos")
    older = now.withColumn("content", F.concat(F.lit("old "), "content", F.lit("\nold end")))
    last = now.where("pos % 7 in (0, 1)").withColumn("content", F.when(F.col("pos") % 7 == 0, "").otherwise("late and outdated"))
    number = F.when(F.col("pos") % 7 == 0, 3).otherwise(0)
    for delivery in (older.withColumn("version", F.lit(1)), now.withColumn("version", F.lit(2)), last.withColumn("version", number)):
        rows = delivery.withColumn("size", F.octet_length("content").cast("bigint")).withColumn("sha", F.sha2("content", 256))
        with shuffles_dropped(spark):
            rows.write.mode("append").option("compression", "zstd").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        jobs.index_stream(stream, target, f"{target}-progress", CHUNK_LIMITS).awaitTermination()
        drop_folder(spark, source)  # what was taken in is not read again
    _STREAMED[key] = target
    return target


LIVE_CHUNKS = "regexp_extract(path, '[0-9]+')::BIGINT % 7 <> 0"
LIVE_SQL = with_ctes(
    FILES_SQL, CHUNKS_SQL,
    select=f"SELECT chunk_id, path, start_byte, end_byte, 64 AS width, true AS has_terms FROM chunks WHERE {LIVE_CHUNKS}",
)


def live_rows(spark, target: str):
    taken = {
        "chunks": ["chunk_id", "start_byte", "end_byte"],
        "embeddings": ["chunk_id", F.size("embedding").alias("width")],
        "postings": [F.size("terms").alias("n_terms")],
    }
    live = jobs.live_index(spark, target, packed=True, columns=taken)
    vectors = live["embeddings"].select("chunk_id", "width")
    terms = live["postings"].groupBy("chunk_id").agg((F.max("n_terms") > 0).alias("has_terms"))
    found = live["chunks"].join(vectors, "chunk_id").join(terms, "chunk_id", "left")
    return found.select("chunk_id", "path", "start_byte", "end_byte", "width", F.coalesce("has_terms", F.lit(False)).alias("has_terms"))


@query("index_stream", LIVE_SQL)
def index_stream(spark, sf_dir):
    """The live rows after all deliveries."""
    return live_rows(spark, streamed(spark, sf_dir))


@query(
    "streamed_counts",
    with_ctes(
        FILES_SQL, CHUNKS_SQL, lexical_sql.POSTINGS_SQL,
        select=f"""SELECT p.repository_id, term, count(*) AS df, any_value(t.total_chunks) AS total_chunks
                   FROM postings p JOIN (SELECT chunk_id FROM chunks WHERE {LIVE_CHUNKS}) c USING (chunk_id)
                   JOIN (SELECT repository_id, count(*) AS total_chunks FROM chunks WHERE {LIVE_CHUNKS} GROUP BY ALL) t ON t.repository_id = p.repository_id
                   GROUP BY p.repository_id, term""",
    ),
)
def streamed_counts(spark, sf_dir):
    """What the batches added to and took from the counts of terms, in sum."""
    live = jobs.live_index(spark, streamed(spark, sf_dir))
    terms = live["term_counts"].groupBy("repository_id", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    totals = live["repository_counts"].groupBy("repository_id").agg(F.sum("chunks").alias("total_chunks"))
    return terms.join(totals, "repository_id").select("repository_id", "term", "df", "total_chunks")


@query("merge_runs", LIVE_SQL)
def merge_runs(spark, sf_dir):
    """The live rows after all runs were merged into one."""
    target = streamed(spark, sf_dir)
    jobs.merge_runs(spark, target)
    return live_rows(spark, target)


def answer_deltas(spark, sf_dir):
    """Assistant turns cut into words; some never finish, some fail."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") % 600)
    base = rows.select(key.alias("message_id"), F.split("text", " ").alias("words"), at.alias("ts"), (F.length("text") % 5).alias("fate"))
    said = base.select(
        "message_id", F.posexplode("words").alias("seq", "word"), F.lit("text").alias("kind"), "ts"
    ).select("message_id", "seq", "kind", F.concat("word", F.lit(" ")).alias("text"), "ts")
    ends = base.where("fate <> 0").select(
        "message_id", F.size("words").alias("seq"), F.when(F.col("fate") == 1, "error").otherwise("done").alias("kind"),
        F.lit(None).cast("string").alias("text"), "ts",
    )
    return said.unionByName(ends)


def disordered(deltas):
    """Three deliveries of the deltas: the end of each message first, every third delta twice, an
    error a moment after some finished, and at last a tick that lets event time pass."""
    late = deltas.where("kind = 'done' AND seq % 4 = 0").select(
        "message_id", "seq", F.lit("error").alias("kind"), "text", (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts")
    )
    tick = deltas.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(
        F.lit("tick").alias("message_id"), F.lit(None).cast("int").alias("seq"), F.lit("tick").alias("kind"), F.lit(None).cast("string").alias("text"), "ts"
    )
    ends = deltas.where("kind <> 'text' OR seq % 2 = 1")
    rest = deltas.where("kind = 'text' AND seq % 3 = 0").unionByName(deltas.where("kind = 'text' AND seq % 2 = 0")).unionByName(late)
    return ends, rest, tick


def run_stream(spark, deliveries, build, name: str):
    """Write deliveries to a folder one after another, stream each through ``build`` to a Parquet sink and read it."""
    source, target = fresh(spark, f"{name}-in"), fresh(spark, name)
    for rows in deliveries:
        rows.write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(rows.schema).parquet(source))
        (
            stream.writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", f"{target}-progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.schema(stream.schema).parquet(target)


ANSWERS_SQL = """SELECT conv_id || '-' || turn AS message_id, len(string_split(text, ' ')) AS deltas, md5(text || ' ') AS answer_md5
  FROM conversations WHERE role = 'assistant' AND length(text) % 5 > 1 AND len(string_split(text, ' ')) % 4 <> 0"""


@query("assemble_answers", ANSWERS_SQL)
def assemble_answers(spark, sf_dir):
    jobs.use_rocksdb(spark)
    out = run_stream(spark, disordered(answer_deltas(spark, sf_dir)), jobs.assemble_answers, "answers")
    return out.select("message_id", "deltas", F.md5("answer").alias("answer_md5"))


@query("assemble_answers_batch", ANSWERS_SQL)
def assemble_answers_batch(spark, sf_dir):
    first, second, tick = disordered(answer_deltas(spark, sf_dir))
    out = jobs.assemble_answers_batch(first.unionByName(second).unionByName(tick))
    return out.select("message_id", "deltas", F.md5("answer").alias("answer_md5"))


RUNS_SQL = """WITH runs AS (
  SELECT user_id, min(ts) AS started_at, bool_or(event_type = 'purchase' AND event_id % 40 = 0) AS finished FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS run_id, epoch_us(started_at) AS started_us, 'stuck' AS status FROM runs WHERE NOT finished"""


def run_events(spark, sf_dir):
    """Users as runs: their events start a run, one purchase in forty finishes it."""
    kind = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 40 == 0), "finished").otherwise("started")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.array(F.lit("started"), kind).alias("kinds"), F.col("ts").cast("timestamp").alias("ts")
    ).select("run_id", F.explode(F.array_distinct("kinds")).alias("kind"), "ts")


@query("stuck_runs", RUNS_SQL)
def stuck_runs(spark, sf_dir):
    out = run_stream(spark, [run_events(spark, sf_dir)], jobs.stuck_runs, "stuck")
    return out.select("run_id", F.unix_micros("started_at").alias("started_us"), "status")


@query("stuck_runs_batch", RUNS_SQL)
def stuck_runs_batch(spark, sf_dir):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    out = jobs.stuck_runs_batch(run_events(spark, sf_dir), now)
    return out.select("run_id", F.unix_micros("started_at").alias("started_us"), "status")
