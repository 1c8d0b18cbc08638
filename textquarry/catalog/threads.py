"""Conversations and the lifecycle of repositories and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog.base import manifest, query, table, with_ctes
from textquarry.catalog.files import JUDGED as JUDGED_FILES
from textquarry.operators import filters, lifecycle, quantiles, threads
from textquarry.settings import IndexLimits
from textquarry.sources.files import conversations_as_messages

RECENT = 3


def messages(spark, sf_dir):
    return conversations_as_messages(table(spark, sf_dir, "conversations"))


@query(
    "recent_messages",
    f"""SELECT conversation_id, message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn, message_id) AS replay_order FROM (
         SELECT conv_id AS conversation_id, conv_id || '-' || turn AS message_id, turn FROM conversations
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, conv_id || '-' || turn DESC) <= {RECENT})""",
)
def recent_messages(spark, sf_dir):
    return threads.recent_messages(messages(spark, sf_dir), RECENT).select("conversation_id", "message_id", "replay_order")


def thread_citations(spark, sf_dir):
    """Each assistant turn cites turn + 1 places."""
    rows = messages(spark, sf_dir).where("role = 'assistant'")
    rank = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("turn") + 1)).alias("rank")
    return rows.select("message_id", rank).select(
        "message_id", "rank", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("label"),
        F.concat(F.lit("f"), (F.col("rank") % 3).cast("string")).alias("path"),
        F.col("rank").alias("start_line"), (F.col("rank") + 5).alias("end_line"),
    )


@query(
    "list_messages",
    """SELECT conv_id || '-' || turn AS message_id, CASE WHEN role = 'assistant' THEN turn + 1 ELSE 0 END AS citations,
              CASE WHEN role = 'assistant' THEN array_to_string(list_transform(range(1, turn + 2), lambda i: 'S' || i), ',') ELSE '' END AS labels
       FROM conversations""",
)
def list_messages(spark, sf_dir):
    listed = threads.list_messages(messages(spark, sf_dir), thread_citations(spark, sf_dir))
    cited = F.coalesce(F.col("citations"), F.array())
    return listed.select(
        "message_id", F.size(cited).alias("citations"), F.array_join(F.transform(cited, lambda c: c["label"]), ",").alias("labels")
    )


@query(
    "list_conversations",
    """SELECT c_nationkey::VARCHAR AS repository_id, c_custkey AS conversation_id,
              row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position
       FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
       QUALIFY position <= 30""",
)
def list_conversations(spark, sf_dir):
    """Customers as threads of their nation; orders are their messages."""
    conversations = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("repository_id"), F.col("c_custkey").alias("conversation_id"),
        F.col("c_acctbal").alias("created_at"),
    )
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation_id"))
    return threads.list_conversations(conversations, said).select("repository_id", "conversation_id", "position")


@query(
    "surviving_citations",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END AS alive, count(*) AS rows
       FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey GROUP BY ALL""",
)
def surviving_citations(spark, sf_dir):
    """Line items cite parts; parts of small size have left the index."""
    citations = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").cast("string").alias("chunk_id")
    )
    chunks = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("chunk_id"))
    kept = threads.surviving_citations(citations, chunks)
    return kept.groupBy("l_orderkey", "l_linenumber", "l_partkey", F.col("chunk_id").isNotNull().cast("int").alias("alive")).agg(
        F.count("*").alias("rows")
    )


@query(
    "answer_metrics",
    """SELECT o_orderpriority AS repository_id, o_orderstatus AS model, count(*) AS answers, sum(o_custkey % 9)::BIGINT AS sources,
              count(*) FILTER (WHERE o_orderkey % 3 = 0) AS useful, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS weak,
              count(*) FILTER (WHERE o_orderkey % 3 = 2) AS without_evidence, min(round(o_totalprice)::BIGINT) AS latency_min,
              median(round(o_totalprice)::BIGINT) AS latency_median, max(round(o_totalprice)::BIGINT) AS latency_max,
              round(sum(o_custkey)::DOUBLE / (count(*) * 2000), 6) AS context_use, sum(o_custkey + o_orderkey)::BIGINT AS tokens
       FROM orders GROUP BY ALL""",
)
def answer_metrics(spark, sf_dir):
    """Orders as answers: price as latency, keys as sizes."""
    key = F.col("o_orderkey")
    answers = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("repository_id"), F.col("o_orderstatus").alias("model"), (F.col("o_custkey") % 9).alias("sources"),
        F.when(key % 3 == 0, "useful").when(key % 3 == 1, "weak").otherwise("none").alias("strength"),
        F.round("o_totalprice").cast("bigint").alias("latency_ms"), F.col("o_custkey").alias("context_chars"),
        F.lit(2_000).alias("context_budget"), F.col("o_custkey").alias("input_tokens"), key.alias("output_tokens"),
    )
    return threads.answer_metrics(answers)


LATENCY = ("o_orderpriority", "o_orderstatus")


@query(
    "exact_median",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, median(round(o_totalprice * 100)::BIGINT) AS median FROM orders GROUP BY ALL""",
)
def exact_median(spark, sf_dir):
    """Prices in cents, halved by narrowing histograms."""
    rows = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return quantiles.exact_median(rows, LATENCY, "cents")


@query(
    "merged_quantile",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, true AS close FROM orders GROUP BY ALL""",
)
def merged_quantile(spark, sf_dir):
    """Daily sketches of prices, merged: the estimate's own rank lies within two percent of the middle."""
    rows = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    days = quantiles.daily_sketches(rows.withColumn("day", F.to_date("o_orderdate")), LATENCY, "day", "cents")
    merged = quantiles.merged_quantile(days, LATENCY)
    below = rows.join(merged, list(LATENCY)).groupBy(*LATENCY, "n").agg(
        F.count_if(F.col("cents") < F.col("quantile")).alias("less"), F.count_if(F.col("cents") <= F.col("quantile")).alias("not_more")
    )
    close = (F.col("less") <= 0.52 * F.col("n")) & (F.col("not_more") >= 0.48 * F.col("n"))
    return below.select(*LATENCY, "n", close.alias("close"))


# ---- lifecycle: suppliers as repositories, orders as changes, customers as threads ------------

STATUSES = ("proposed", "approved", "rejected", "stale", "failed", "executing", "committed", "pr_created")
INDEXING = ("indexed", "indexed", "indexed", "indexed", "indexed", "not_indexed", "indexing", "failed")

# Suppliers of some residues have few kinds of change, so every branch of the workflow occurs.
CHANGES_SQL = f"""repositories AS (
  SELECT s_suppkey AS repository_id, (['{"', '".join(INDEXING)}'])[s_suppkey % 8 + 1] AS indexing_status FROM supplier),
changes AS (
  SELECT o_orderkey AS change_id, o_custkey % (SELECT count(*) FROM supplier) AS repository_id,
         CASE (o_custkey % (SELECT count(*) FROM supplier)) % 5 WHEN 0 THEN (['{"', '".join(STATUSES)}'])[o_orderkey % 8 + 1]
           WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'proposed' ELSE 'rejected' END WHEN 2 THEN 'pr_created' ELSE 'failed' END AS status,
         o_orderdate FROM orders),
known_changes AS (SELECT * FROM changes WHERE status IS NOT NULL),
conversations_of AS (SELECT c_custkey % (SELECT count(*) FROM supplier) AS repository_id, c_custkey FROM customer)"""


def lifecycle_tables(spark, sf_dir):
    supplier, orders, customer = (table(spark, sf_dir, n) for n in ("supplier", "orders", "customer"))
    # The number of suppliers, one row, read where each row needs it.
    count = F.broadcast(supplier.agg(F.count("*").alias("n"), F.lit(1).alias("one")))
    pick = lambda values, column: F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))
    repositories = supplier.select(F.col("s_suppkey").alias("repository_id"), pick(INDEXING, F.col("s_suppkey")).alias("indexing_status"))
    key = F.col("o_orderkey")
    kind = F.col("repository_id") % 5
    changes = (
        orders.withColumn("one", F.lit(1)).join(count, "one")
        .select(key.alias("change_id"), (F.col("o_custkey") % F.col("n")).alias("repository_id"), "o_orderdate", "o_orderkey", "o_totalprice")
        .withColumn(
            "status",
            F.when(kind == 0, pick(STATUSES, key)).when(kind == 1, F.when(key % 2 == 0, "proposed").otherwise("rejected"))
            .when(kind == 2, "pr_created").otherwise("failed"),
        )
    )
    conversations = (
        customer.withColumn("one", F.lit(1)).join(count, "one")
        .select("c_custkey", (F.col("c_custkey") % F.col("n")).alias("repository_id"))
    )
    return repositories, conversations, changes


WORKFLOW_SQL = """tallies AS (
  SELECT r.repository_id, r.indexing_status, coalesce(c.changes, 0) AS changes, coalesce(c.proposed, 0) AS proposed, coalesce(c.reviewed, 0) AS reviewed,
         coalesce(c.ready_to_ship, 0) AS ready_to_ship, coalesce(c.executing, 0) AS executing, coalesce(c.shipped, 0) AS shipped,
         coalesce(t.conversations, 0) AS conversations
  FROM repositories r LEFT JOIN (
    SELECT repository_id, count(*) AS changes, count(*) FILTER (WHERE status = 'proposed') AS proposed,
      count(*) FILTER (WHERE status IN ('approved', 'rejected', 'executing', 'committed', 'pr_created')) AS reviewed,
      count(*) FILTER (WHERE status IN ('approved', 'committed')) AS ready_to_ship, count(*) FILTER (WHERE status = 'executing') AS executing,
      count(*) FILTER (WHERE status = 'pr_created') AS shipped FROM known_changes GROUP BY repository_id) c USING (repository_id)
  LEFT JOIN (SELECT repository_id, count(*) AS conversations FROM conversations_of GROUP BY repository_id) t USING (repository_id)),
nexts AS (
  SELECT *, CASE WHEN indexing_status <> 'indexed' THEN 'repository' WHEN ready_to_ship > 0 THEN 'ship' WHEN proposed > 0 THEN 'review'
      WHEN conversations = 0 THEN 'ask' WHEN changes = 0 THEN 'investigate' ELSE 'ask' END AS next_stage,
    CASE indexing_status WHEN 'failed' THEN 'retry_index' WHEN 'indexing' THEN 'watch_index' WHEN 'not_indexed' THEN 'build_index' ELSE
      CASE WHEN ready_to_ship > 0 THEN 'open_change' WHEN proposed > 0 THEN 'review_change' WHEN conversations = 0 THEN 'first_question'
           WHEN changes = 0 THEN 'first_change' ELSE 'next_question' END END AS next_action FROM tallies),
workflow AS (
  SELECT *, CASE WHEN next_stage = 'repository' THEN 'current' WHEN indexing_status = 'indexed' THEN 'done' ELSE 'available' END AS repository_state,
    CASE WHEN next_stage = 'ask' THEN 'current' WHEN conversations > 0 THEN 'done' WHEN indexing_status <> 'indexed' THEN 'locked' ELSE 'available' END AS ask_state,
    CASE WHEN next_stage = 'investigate' THEN 'current' WHEN changes > 0 THEN 'done' WHEN indexing_status <> 'indexed' THEN 'locked' ELSE 'available' END AS investigate_state,
    CASE WHEN next_stage = 'review' THEN 'current' WHEN reviewed > 0 AND proposed = 0 THEN 'done' WHEN proposed + reviewed = 0 THEN 'locked' ELSE 'available' END AS review_state,
    CASE WHEN next_stage = 'ship' THEN 'current' WHEN shipped > 0 AND ready_to_ship = 0 THEN 'done'
         WHEN ready_to_ship + executing + shipped = 0 THEN 'locked' ELSE 'available' END AS ship_state FROM nexts)"""


@query("workflow_state", with_ctes(CHANGES_SQL, WORKFLOW_SQL, select="SELECT * FROM workflow"))
def workflow_state(spark, sf_dir):
    return lifecycle.workflow_state(*lifecycle_tables(spark, sf_dir))


@query(
    "journey",
    with_ctes(
        CHANGES_SQL, WORKFLOW_SQL,
        """steps AS (
  SELECT repository_id, indexing_status, unnest([1, 2, 3, 4, 5, 6]) AS position,
         unnest(['connect', 'index', 'understand', 'investigate', 'review', 'ship']) AS step,
         unnest(['done', repository_state, ask_state, investigate_state, review_state, ship_state]) AS stage_state FROM workflow)""",
        select="""SELECT repository_id, position, step, CASE WHEN stage_state IN ('current', 'done') THEN stage_state ELSE 'upcoming' END AS state,
                         stage_state = 'locked' AS locked, step = 'index' AND indexing_status = 'failed' AS attention FROM steps""",
    ),
)
def journey(spark, sf_dir):
    return lifecycle.journey(lifecycle.workflow_state(*lifecycle_tables(spark, sf_dir)))


@query(
    "last_activity",
    with_ctes(
        CHANGES_SQL,
        select="""SELECT r.repository_id, greatest(epoch(TIMESTAMP '1990-01-01')::BIGINT + r.repository_id * 60,
                         coalesce((SELECT max(epoch(o_orderdate)::BIGINT + 86400 * (change_id % 5)) FROM known_changes k WHERE k.repository_id = r.repository_id), 0),
                         coalesce((SELECT max(epoch(TIMESTAMP '1999-06-01')::BIGINT + c_custkey) FROM conversations_of c WHERE c.repository_id = r.repository_id), 0)) AS last_activity
                  FROM repositories r""",
    ),
)
def last_activity(spark, sf_dir):
    repositories, conversations, changes = lifecycle_tables(spark, sf_dir)
    never = F.lit(None).cast("timestamp")
    at = lambda start, seconds: F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + seconds)
    dated = F.col("o_orderdate").cast("timestamp")
    later = F.timestamp_seconds(F.unix_timestamp(dated) + 86_400 * (F.col("change_id") % 5))
    out = lifecycle.last_activity(
        repositories.withColumn("created_at", at("1990-01-01", F.col("repository_id") * 60)).withColumn("indexed_at", never),
        conversations.withColumn("created_at", at("1999-06-01", F.col("c_custkey"))),
        changes.withColumn("created_at", dated).withColumn("reviewed_at", later).withColumn("executed_at", never),
    )
    return out.select("repository_id", F.unix_timestamp("last_activity").alias("last_activity"))


@query(
    "review_groups",
    with_ctes(
        CHANGES_SQL,
        select="""SELECT repository_id, CASE WHEN status = 'proposed' THEN 'needs-review' WHEN status IN ('approved', 'executing', 'committed') THEN 'ready-to-ship'
                         WHEN status = 'pr_created' THEN 'shipped' ELSE 'closed' END AS review_group, count(*) AS changes FROM known_changes GROUP BY ALL""",
    ),
)
def review_groups(spark, sf_dir):
    return lifecycle.review_groups(lifecycle_tables(spark, sf_dir)[2])


@query(
    "review_transitions",
    with_ctes(
        CHANGES_SQL,
        """decisions AS (
  SELECT DISTINCT l_orderkey * 10 + l_linenumber AS decision_id, l_orderkey AS change_id, l_linenumber % 2 = 1 AS approve FROM lineitem),
decided AS (
  SELECT d.*, k.status, d.change_id % 4 = 0 AS is_stale, row_number() OVER (PARTITION BY d.change_id ORDER BY decision_id) AS n,
         first_value(approve) OVER (PARTITION BY d.change_id ORDER BY decision_id) AS first_approves
  FROM decisions d LEFT JOIN known_changes k USING (change_id)),
judged_decisions AS (
  SELECT *, CASE WHEN status IS NULL THEN 'unknown_change' WHEN status = 'proposed' AND n > 1 AND first_approves AND is_stale THEN 'not_reviewable'
      WHEN status IN ('approved', 'rejected') OR (status = 'proposed' AND n > 1) THEN 'already_reviewed'
      WHEN status <> 'proposed' THEN 'not_reviewable' END AS conflict FROM decided)""",
        select="""SELECT decision_id, coalesce(conflict, '') AS conflict, CASE WHEN conflict IS NOT NULL THEN ''
                         WHEN approve AND is_stale THEN 'stale' WHEN approve THEN 'approved' ELSE 'rejected' END AS new_status FROM judged_decisions""",
    ),
)
def review_transitions(spark, sf_dir):
    """Line items as decisions on the order they belong to."""
    changes = lifecycle_tables(spark, sf_dir)[2].select("change_id", "status", (F.col("change_id") % 4 == 0).alias("is_stale"))
    decisions = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("decision_id"), F.col("l_orderkey").alias("change_id"),
        (F.col("l_linenumber") % 2 == 1).alias("approve"),
    ).distinct()
    out = lifecycle.review_transitions(changes, decisions)
    return out.select(
        "decision_id", F.coalesce("conflict", F.lit("")).alias("conflict"), F.coalesce("new_status", F.lit("")).alias("new_status")
    )


@query(
    "claimable_changes",
    with_ctes(
        CHANGES_SQL,
        select="""SELECT change_id, CASE WHEN status <> 'executing' THEN status WHEN change_id % 3 = 0 THEN 'committed' ELSE 'approved' END AS resume_from
                  FROM known_changes WHERE status IN ('approved', 'committed')
                     OR (status = 'executing' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE)""",
    ),
)
def claimable_changes(spark, sf_dir):
    """As of the start of 1998; every third change has a commit and a branch."""
    done = F.when(F.col("change_id") % 3 == 0, "x")
    changes = lifecycle_tables(spark, sf_dir)[2].select(
        "change_id", "status", F.col("o_orderdate").cast("timestamp").alias("updated_at"), done.alias("commit_sha"), done.alias("branch_name")
    )
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return lifecycle.claimable_changes(changes, now).select("change_id", "resume_from")


@query(
    "index_runs",
    """SELECT event_id, event_type <> 'error' OR ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 30 MINUTE AS may_start FROM events""",
)
def index_runs(spark, sf_dir):
    """Events as runs; errors are the ones still in progress, as of mid January."""
    runs = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "indexing").otherwise("indexed").alias("indexing_status"),
        F.col("ts").cast("timestamp").alias("indexing_started_at"),
    )
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return lifecycle.index_runs(runs, now).select("event_id", "may_start")


@query(
    "run_report",
    with_ctes(
        *JUDGED_FILES,
        select="""SELECT repository_id, count(*) AS files_discovered, count(skip_reason) AS files_skipped,
                         count(*) FILTER (WHERE skip_reason IS NULL) AS files_indexed,
                         count(*) FILTER (WHERE skip_reason IS NULL AND parseable AND pos % 10 <> 0) AS files_parsed,
                         count(*) FILTER (WHERE skip_reason IS NULL AND parseable AND pos % 10 = 0) AS parse_failures,
                         coalesce(sum(pos % 4) FILTER (WHERE skip_reason IS NULL), 0)::BIGINT AS chunks_created,
                         coalesce(sum(pos % 4) FILTER (WHERE skip_reason IS NULL), 0)::BIGINT AS chunks_embedded,
                         coalesce(sum(pos % 4) FILTER (WHERE skip_reason IS NULL AND pos % 2 = 0), 0)::BIGINT AS chunks_reused,
                         count(*) FILTER (WHERE skip_reason IS NULL AND parseable AND pos % 10 = 0) = 0 AS complete
                  FROM judged GROUP BY repository_id""",
    ),
)
def run_report(spark, sf_dir):
    """A run over the manifest: every tenth structured file fails to parse, files have up to three chunks."""
    decisions = filters.metadata_decision(manifest(spark, sf_dir), IndexLimits(max_file_bytes=512_000))
    kept = decisions.where(F.col("skip_reason").isNull())
    broken = F.col("parseable") & (F.col("pos") % 10 == 0)
    files = kept.withColumn("is_parsed", F.col("parseable") & ~broken).withColumn("parse_error", F.when(broken, "syntax"))
    chunks = kept.where("pos % 4 > 0").select(
        "repository_id", "pos", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pos") % 4)).alias("part")
    )
    embeddings = chunks.withColumn("reused", F.col("pos") % 2 == 0)
    return lifecycle.run_report(decisions, files, chunks, embeddings)
