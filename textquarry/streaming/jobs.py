"""Streaming jobs. Each gives the result of its batch counterpart once its input is complete."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from textquarry.operators import lexical, lexical_index
from textquarry.plans import index as plan
from textquarry.session import cut_lineage, drop_folder, tables_dropped
from textquarry.settings import INDEX, IndexLimits
from textquarry.sources import sinks

FILE_KEYS = ["repository_id", "path"]


def latest_versions(files: DataFrame) -> DataFrame:
    """Last version per file; only (version, sha) meets in the aggregate, content joins back."""
    last = files.groupBy(*FILE_KEYS).agg(F.max("version").alias("version"))
    return sinks.of_keys(files, last, [*FILE_KEYS, "version"])


def index_batch(
    files: DataFrame,
    known_vectors: Callable[[DataFrame], DataFrame] | None,
    limits: IndexLimits = INDEX,
    store: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Index tables of one batch of file versions, reusing vectors of known chunk texts.

    Every file keeps rows of its own, also if another has the same content: which copy arrives
    first would otherwise decide what is found. ``known_vectors`` gives the stored vectors for the
    content hashes of the batch. ``store`` writes files, chunks and postings, which later tables are derived
    from, and gives back what was written. Postings are packed, one row per chunk.
    """
    store = store or (lambda name, rows: cut_lineage(rows))
    decisions = plan.filters.metadata_decision(latest_versions(files), limits)
    stored = store("files", plan.filters.prepare_files(plan.read_files(decisions, one_per_blob=False)))
    chunks = store("chunks", plan.chunking.chunk_files(plan.chunking.spans_by_pattern(stored), limits))
    postings = store("postings", lexical.packed_postings(chunks))
    previous = None if known_vectors is None else known_vectors(plan.hashed_chunks(chunks))
    vectors = plan.chunk_embeddings(chunks, postings, previous)
    return {
        "files": stored,
        "chunks": chunks,
        "postings": postings,
        "embeddings": vectors.join(chunks.select("chunk_id", "path"), "chunk_id"),
    }


HASH_FOLDERS = 16
#: Tables with a row per file, chunk or posting, and the folders within a run.
INDEX_FOLDERS = {"files": [], "chunks": [], "postings": [], "embeddings": ["bucket"]}
COUNTS = ("term_counts", "repository_counts")


def hash_bucket(content_hash: Column) -> Column:
    """The folder of a vector, by the hash of its text."""
    return (F.conv(F.left(content_hash, F.lit(2)), 16, 10).cast("int") % HASH_FOLDERS).cast("int")


def stored_vectors(embeddings: DataFrame, hashed: DataFrame) -> DataFrame:
    """The stored vectors of some chunk texts, of any run; only the folders of their hashes are read."""
    wanted = hashed.select(hash_bucket(F.col("content_hash")).alias("bucket"), "content_hash").distinct()
    return sinks.in_folders(embeddings, "bucket", wanted).join(wanted, ["bucket", "content_hash"], "left_semi")


def _write_index(tables: dict[str, DataFrame], index_path: str, run: str) -> None:
    for name, rows in tables.items():
        folders = INDEX_FOLDERS.get(name, [])
        if folders:
            rows = rows.withColumn("bucket", hash_bucket(F.col("content_hash"))).repartition("bucket")
        sinks.write_run(rows, f"{index_path}/{name}", run, folders)


def live_index(spark, index_path: str, packed: bool = False, columns: dict[str, list[Column]] | None = None) -> dict[str, DataFrame]:
    """The tables of a streamed index, each file in its newest version, and the counts of its terms.

    Postings are one row per chunk and term, or, if ``packed``, one per chunk as they are stored.
    ``columns`` are made in the rows of a table, besides its keys, before they meet the current runs: what
    a reader takes of a wide column then moves instead of it. Runs without a current file are not read.
    """
    runs = spark.read.parquet(f"{index_path}/runs")
    current = sinks.current_runs(runs, FILE_KEYS)
    named = sinks.folders_asked("run", current)
    keys = {"postings": ["repository_id", "chunk_id"]}

    def read(name: str) -> DataFrame:
        rows = sinks.read_table(spark, f"{index_path}/{name}").where(named)
        return rows.select(*keys.get(name, FILE_KEYS), "run", *columns[name]) if name in (columns or {}) else rows

    tables = {name: sinks.of_keys(read(name), current, [*FILE_KEYS, "run"]).drop("run") for name in ("files", "chunks", "embeddings")}
    postings = _postings_of(sinks.read_table(spark, f"{index_path}/chunks").where(named), read("postings"), current)
    tables["postings"] = postings if packed else lexical.unpacked(postings)
    for name in COUNTS:
        tables[name] = sinks.read_table(spark, f"{index_path}/{name}").join(sinks.live_runs(runs), "run", "left_semi").drop("run")
    return tables


def _of_some(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have one of the keys, of which there can be far fewer than rows; the planner sees to that."""
    return rows.join(keys, on, "left_semi")


def _postings_of(chunks: DataFrame, postings: DataFrame, files: DataFrame, of: Callable[..., DataFrame] = sinks.of_keys) -> DataFrame:
    """The packed postings of some files' chunks; ``files`` names the run of each."""
    known = of(chunks, files, [*FILE_KEYS, "run"]).select("repository_id", "chunk_id", "run")
    return of(postings, known, ["repository_id", "chunk_id", "run"]).drop("run")


def _narrow(terms: Column) -> list[Column]:
    """Packed terms as one string and two arrays of numbers, of which far less moves."""
    return [F.array_join(terms["term"], "\n").alias("names"), terms["tf_names"].alias("in_names"), terms["tf_body"].alias("in_body")]


def _widened() -> Column:
    """Packed terms from what ``_narrow`` made of them."""
    term = F.when(F.size("in_body") > 0, F.split("names", "\n")).otherwise(F.array().cast("array<string>"))
    return F.arrays_zip(term.alias("term"), F.col("in_names").alias("tf_names"), F.col("in_body").alias("tf_body"))


def _counted(postings: DataFrame) -> DataFrame:
    """What counts take of packed postings: the names of a chunk's terms in one string, and if its body has one."""
    in_body = F.coalesce(F.array_max(F.col("terms.tf_body")) > 0, F.lit(False))
    carry = [c for c in ("run",) if c in postings.columns]
    return postings.select("repository_id", "chunk_id", *carry, F.array_join("terms.term", "\n").alias("names"), in_body.alias("in_body"))


def _counts(chunks: DataFrame, counted: DataFrame, sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """What some chunks add to, or take from, the counts of terms and of repositories."""
    term = counted.select("repository_id", F.explode(F.split("names", "\n")).alias("term")).where("term <> ''")
    terms = term.groupBy("repository_id", "term").agg((F.count("*") * sign).alias("df"))
    return terms, lexical_index.counted_repositories(chunks, counted.where("in_body"), sign)


def count_changes(tables: dict[str, DataFrame], batch: DataFrame, run: str, index_path: str, runs: DataFrame | None) -> dict[str, DataFrame]:
    """What a batch changes in the counts: its new versions are added, those they replace are taken away.

    A version that is not newer than the current one stays unseen and is not counted. Only the
    runs that hold replaced files are read. ``runs`` are those published before this run.
    """
    spark = batch.sparkSession
    fresh = batch.groupBy(*FILE_KEYS).agg(F.max("version").cast("bigint").alias("version"))
    if runs is None:
        current = None
    else:
        newest = runs.where("path IS NOT NULL").groupBy(*FILE_KEYS).agg(F.max(F.struct("at", "run")).alias("now"))
        judged = fresh.join(newest, FILE_KEYS, "left")
        newer = F.col("now").isNull() | (F.struct(F.col("version").alias("at"), F.lit(run).alias("run")) > F.col("now"))
        judged = cut_lineage(judged.where(newer))
        fresh = judged.select(*FILE_KEYS)
        current = judged.where("now IS NOT NULL").select(*FILE_KEYS, F.col("now.run").alias("run"))
    chunks, counted = tables["chunks"], _counted(tables["postings"])
    if current is not None:  # else all files of the batch count
        chunks = _of_some(chunks, fresh.select(*FILE_KEYS), FILE_KEYS)
        counted = _of_some(counted, chunks.select("repository_id", "chunk_id"), ["repository_id", "chunk_id"])
    terms, totals = _counts(chunks, counted)
    if current is not None:
        named = sinks.folders_asked("run", current)
        read = lambda name: sinks.read_table(spark, f"{index_path}/{name}").where(named)
        old = _of_some(read("chunks"), current, [*FILE_KEYS, "run"]).drop("run")
        taken, fewer = _counts(old, _postings_of(read("chunks"), _counted(read("postings")), current, _of_some), -1)
        terms, totals = terms.unionByName(taken), totals.unionByName(fewer)
    return {
        "term_counts": terms.groupBy("repository_id", "term").agg(F.sum("df").alias("df")).where("df <> 0"),
        "repository_counts": totals.groupBy("repository_id").agg(F.sum("chunks").alias("chunks"), F.sum("lexical_chunks").alias("lexical_chunks")),
    }


def index_stream(files_stream: DataFrame, index_path: str, checkpoint: str, limits: IndexLimits = INDEX) -> StreamingQuery:
    """Keep an index current: the newest version of a file replaces that file's rows.

    A batch adds the rows of its files as one run and then names itself the current run of each
    of them, with the file's version. Nothing is rewritten, so a large repository costs no more
    than its changed files; a file that no longer yields a chunk has no current rows; an older
    version that arrives late stays unseen; and a replay writes the same run again. Vectors are
    looked up in the folders of the batch's own hashes, and the counts of terms change by what the
    batch adds and replaces.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"batch-{batch_id:012d}"
        runs = known = None
        if sinks.exists(spark, f"{index_path}/runs"):
            runs = spark.read.parquet(f"{index_path}/runs").where(F.col("run") != run)
            known = lambda hashed: stored_vectors(
                sinks.read_table(spark, f"{index_path}/embeddings").where(F.col("run") != run), hashed
            )
        store = lambda name, rows: sinks.write_run(rows, f"{index_path}/{name}", run)
        with tables_dropped(spark):
            tables = index_batch(batch, known, limits, store)
            _write_index({"embeddings": tables["embeddings"]}, index_path, run)
            _write_index(count_changes(tables, batch, run, index_path, runs), index_path, run)
        sinks.publish_run(batch, f"{index_path}/runs", run, FILE_KEYS, F.col("version"))

    return (
        files_stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_runs(spark, index_path: str) -> str:
    """Write the live rows of all runs as one run and make it current; returns its name.

    The index holds the same rows before and after, and while the merge runs: its run is unseen
    until it is published in one append, so an interrupted merge changes nothing and is simply
    made again. No batch may be published meanwhile.
    """
    runs = spark.read.parquet(f"{index_path}/runs")
    merged = f"merged-{runs.where(F.col('run').startswith('merged-')).select('run').distinct().count():012d}"
    kind = sinks.read_table(spark, f"{index_path}/postings").schema["terms"].dataType
    tables = live_index(spark, index_path, packed=True, columns={"postings": ["chunk_terms", *_narrow(F.col("terms"))]})
    tables["postings"] = tables["postings"].select("repository_id", "chunk_id", "chunk_terms", _widened().cast(kind).alias("terms"))
    terms, totals = (tables[name] for name in COUNTS)
    tables["term_counts"] = terms.groupBy("repository_id", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    tables["repository_counts"] = totals.groupBy("repository_id").agg(F.sum("chunks").alias("chunks"), F.sum("lexical_chunks").alias("lexical_chunks"))
    _write_index({name: rows.drop("bucket") for name, rows in tables.items()}, index_path, merged)
    sinks.publish_merge(runs, f"{index_path}/runs", merged, FILE_KEYS)
    return merged


def drop_covered(spark, index_path: str) -> list[str]:
    """Delete the rows of runs that a merged run covers; returns the runs. No reader may use them any more."""
    runs = spark.read.parquet(f"{index_path}/runs")
    gone = [r["run"] for r in runs.select("run").distinct().join(sinks.live_runs(runs), "run", "left_anti").collect()]
    for name in (*INDEX_FOLDERS, *COUNTS):
        for run in gone:
            drop_folder(spark, f"{index_path}/{name}/run={run}")
    return sorted(gone)


ANSWER = "message_id string, answer string, deltas int"
PAGE = 128
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Answers(StatefulProcessor):
    """The deltas of a message by seq, in pages; its verdict falls once it has been silent."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "seqs array<int>, texts array<string>")
        self.ends = handle.getValueState("ends", "expected int, failed boolean, newest bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        expected, failed, newest = self.ends.get() if self.ends.exists() else (-1, False, -1)
        before, said = newest, {}
        for frame in rows:
            for seq, kind, text, ts in zip(frame["seq"], frame["kind"], frame["text"], frame["ts"]):
                newest = max(newest, int(ts.timestamp() * 1000))
                failed = failed or kind == "error"
                if kind == "done" and not pd.isna(seq):
                    expected = max(expected, int(seq))
                elif kind == "text" and not pd.isna(seq) and text is not None:
                    page = said.setdefault(int(seq) // PAGE, {})
                    page[int(seq)] = min(text, page.get(int(seq), text))
        for number, page in said.items():
            if self.pages.containsKey((number,)):
                for seq, text in zip(*self.pages.getValue((number,))):
                    page[seq] = min(text, page.get(seq, text))
            self.pages.updateValue((number,), (list(page), list(page.values())))
        self.ends.update((expected, failed, newest))
        if newest != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(newest + self.silence_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, failed, _ = self.ends.get()
        parts = {} if failed else {seq: text for value in self.pages.values() for seq, text in zip(*value)}
        self.pages.clear()
        self.ends.clear()
        if not failed and expected >= 0 and all(seq in parts for seq in range(expected)):
            answer = "".join(parts[seq] for seq in range(expected))
            yield pd.DataFrame({"message_id": [key[0]], "answer": [answer], "deltas": [expected]})

    def close(self) -> None:
        pass


def assemble_answers(deltas: DataFrame, silence: str = "10 minutes") -> DataFrame:
    """Concatenate the text deltas of each message; emit it once it is complete and settled.

    ``deltas``: message_id, seq, kind (text, done, error), text, ts. ``done`` carries the number
    of text deltas in ``seq``. A message is judged when it has been silent for the given event
    time: it is an answer if each seq below that number has come and no error has, in whatever
    order, over however many batches, and however often a delta came. If a seq came with several
    texts, the least one counts. Anything else is dropped: a partial answer is no answer. State
    holds one message, whose length is bounded by the answer itself; it is kept in the session's
    state store, which must be RocksDB (``use_rocksdb``).
    """
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    return (
        deltas.where("message_id IS NOT NULL").withWatermark("ts", silence)
        .groupBy("message_id")
        .transformWithStateInPandas(_Answers(silence_ms), ANSWER, "Append", "EventTime")
    )


def use_rocksdb(spark) -> None:
    """Let streams started from now on in this session keep their state in RocksDB."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def assemble_answers_batch(deltas: DataFrame) -> DataFrame:
    """Same result over a finished table; deltas meet by (message, seq) before they meet by message."""
    named = deltas.where("message_id IS NOT NULL")
    parts = named.where("kind = 'text'").groupBy("message_id", "seq").agg(F.min("text").alias("text")).where("seq >= 0 AND text IS NOT NULL")
    ends = named.groupBy("message_id").agg(
        F.max(F.when(F.col("kind") == "done", F.col("seq"))).alias("expected"), F.bool_or(F.col("kind") == "error").alias("failed")
    ).where("NOT failed AND expected >= 0")
    wanted = ends.join(parts, "message_id", "left").where("seq IS NULL OR seq < expected OR expected = 0")
    inside = F.when(F.col("seq") < F.col("expected"), F.struct("seq", "text"))
    whole = wanted.groupBy("message_id", "expected").agg(F.array_sort(F.collect_list(inside)).alias("parts"))
    return whole.where(F.size("parts") == F.col("expected")).select(
        "message_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("answer"), F.col("expected").cast("int").alias("deltas")
    )


RUN = "run_id string, started_at timestamp, status string"
RUN_STATE = "started long, finished boolean"


def stuck_runs(events: DataFrame, limit: str = "30 minutes") -> DataFrame:
    """Runs that started and showed no end within the limit of event time.

    ``events``: run_id, kind (started, finished), ts.
    """
    limit_ms = int(pd.Timedelta(limit).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, finished = state.get
            state.remove()
            if finished or started is None:
                return
            yield pd.DataFrame(
                {"run_id": [key[0]], "started_at": [pd.Timestamp(started, unit="us")], "status": ["stuck"]}
            )
            return
        started, finished = state.get if state.exists else (None, False)
        for frame in frames:
            starts = frame.loc[frame["kind"] == "started", "ts"]
            if len(starts):
                first = int(starts.min().value // 1000)
                started = first if started is None else min(started, first)
            finished = finished or bool((frame["kind"] == "finished").any())
        # A run that has ended is remembered until its start can no longer arrive.
        state.update((started, finished))
        since = state.getCurrentWatermarkMs() if started is None else started // 1000
        state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", "1 minute")
        .groupBy("run_id")
        .applyInPandasWithState(step, RUN, RUN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def stuck_runs_batch(events: DataFrame, now, limit_minutes: int = 30) -> DataFrame:
    """Same decision over a finished table: started before the limit, never finished."""
    runs = events.groupBy("run_id").agg(
        F.min(F.when(F.col("kind") == "started", F.col("ts"))).alias("started_at"),
        F.bool_or(F.col("kind") == "finished").alias("_finished"),
    )
    late = F.col("started_at") < now - F.make_dt_interval(mins=F.lit(limit_minutes))
    return runs.where(~F.col("_finished") & late).select("run_id", "started_at", F.lit("stuck").alias("status"))
