"""Anchored edits, diffs, staleness and grounded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.catalog.base import FILES_SQL, document_files, query, table, with_ctes
from textquarry.operators import diffs, edits, results

# Two edits per document: its first line gets a prefix, a line is added after its last. Short or
# repeated lines make some anchors ambiguous, one-line documents make them overlap.
EDITS_SQL = """edit_lines AS (
  SELECT pos AS proposal_id, repository_id, path, string_split(content, chr(10)) AS ls, content FROM files),
edits AS (
  SELECT proposal_id, repository_id, path, 1 AS edit, ls[1] AS old_text, 'Edited: ' || ls[1] AS new_text FROM edit_lines
  UNION ALL
  SELECT proposal_id, repository_id, path, 2, ls[len(ls)], ls[len(ls)] || chr(10) || 'Added.' FROM edit_lines),
anchors AS (
  SELECT e.*, f.content, (length(f.content) - length(replace(f.content, e.old_text, ''))) // nullif(length(e.old_text), 0) AS occurrences,
         instr(f.content, e.old_text) AS anchor_start
  FROM edits e JOIN files f USING (repository_id, path)),
placed AS (
  SELECT proposal_id, repository_id, path, edit, old_text, new_text, content, coalesce(occurrences, 0) AS occurrences,
    CASE WHEN occurrences = 1 THEN anchor_start ELSE 0 END AS anchor_start,
    CASE WHEN occurrences = 1 THEN anchor_start + length(old_text) ELSE 0 END AS anchor_end,
    CASE WHEN coalesce(occurrences, 0) = 0 THEN 'not_found' WHEN occurrences = 1 THEN 'unique' ELSE 'ambiguous' END AS anchor_status,
    CASE WHEN occurrences = 1 THEN 1 + length(left(content, anchor_start - 1)) - length(replace(left(content, anchor_start - 1), chr(10), '')) ELSE 0 END AS start_line
  FROM anchors),
usable AS (
  SELECT proposal_id, repository_id, path, any_value(content) AS original, max(anchor_start) FILTER (WHERE edit = 2) AS s2,
         max(anchor_end) FILTER (WHERE edit = 1) AS e1, max(anchor_start) FILTER (WHERE edit = 1) AS s1, max(anchor_end) FILTER (WHERE edit = 2) AS e2,
         max(new_text) FILTER (WHERE edit = 1) AS n1, max(new_text) FILTER (WHERE edit = 2) AS n2
  FROM placed GROUP BY proposal_id, repository_id, path
  HAVING bool_and(anchor_status = 'unique') AND max(anchor_start) FILTER (WHERE edit = 2) >= max(anchor_end) FILTER (WHERE edit = 1)),
patched AS (
  SELECT *, left(original, s1 - 1) || n1 || substr(original, e1, s2 - e1) || n2 || substr(original, e2) AS updated FROM usable)"""


def document_edits(spark, sf_dir):
    files = document_files(spark, sf_dir)
    lines = F.split("content", "\n")
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    pairs = F.array(
        F.struct(F.lit(1).alias("edit"), first.alias("old_text"), F.concat(F.lit("Edited: "), first).alias("new_text")),
        F.struct(F.lit(2).alias("edit"), last.alias("old_text"), F.concat(last, F.lit("\nAdded.")).alias("new_text")),
    )
    rows = files.select(F.col("pos").alias("proposal_id"), "repository_id", "path", F.inline(pairs))
    return rows, files


def located(spark, sf_dir):
    rows, files = document_edits(spark, sf_dir)
    return edits.locate_anchors(rows, files), files


def patched(spark, sf_dir):
    anchors, files = located(spark, sf_dir)
    applied = edits.apply_edits(anchors, files)
    return applied.withColumn("change_id", F.col("proposal_id"))


@query(
    "validate_edits",
    """SELECT o_orderkey, edit, CASE WHEN count(*) OVER (PARTITION BY o_orderkey) > 20 THEN 'too_many_edits'
                WHEN trim(path) = '' THEN 'no_path' WHEN new_text IS NULL THEN 'missing_text' WHEN old_text = new_text THEN 'no_change'
                WHEN trim(old_text) = '' THEN 'blank_anchor' WHEN path LIKE '/%' OR path LIKE '%..%' THEN 'path_out_of_scope' END AS rejected
       FROM (SELECT l_orderkey % 2000 AS o_orderkey, l_orderkey * 10 + l_linenumber AS edit,
               CASE l_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN '/etc/' || l_partkey WHEN 2 THEN 'a/../' || l_partkey ELSE 'src/' || l_partkey || '.py' END AS path,
               CASE l_suppkey % 5 WHEN 0 THEN '  ' ELSE 'x' || l_suppkey END AS old_text,
               CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN CASE l_suppkey % 5 WHEN 0 THEN '  ' ELSE 'x' || l_suppkey END ELSE 'y' END AS new_text FROM lineitem)""",
)
def validate_edits(spark, sf_dir):
    """Line items as edits: paths, anchors and replacements of every good and bad kind."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    anchor = F.when(supplier % 5 == 0, "  ").otherwise(F.concat(F.lit("x"), supplier.cast("string")))
    path = (
        F.when(part % 6 == 0, " ")
        .when(part % 6 == 1, F.concat(F.lit("/etc/"), part.cast("string")))
        .when(part % 6 == 2, F.concat(F.lit("a/../"), part.cast("string")))
        .otherwise(F.concat(F.lit("src/"), part.cast("string"), F.lit(".py")))
    )
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 2000).alias("proposal_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit"),
        path.alias("path"), anchor.alias("old_text"),
        F.when(F.col("l_linenumber") == 2, anchor).when(F.col("l_linenumber") != 1, "y").alias("new_text"),
    )
    return edits.validate_edits(rows).select(F.col("proposal_id").alias("o_orderkey"), "edit", "rejected")


@query(
    "locate_anchors",
    with_ctes(FILES_SQL, EDITS_SQL, select="SELECT path, edit, occurrences, anchor_start, anchor_end, anchor_status, start_line FROM placed"),
)
def locate_anchors(spark, sf_dir):
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return located(spark, sf_dir)[0].select(
        "path", "edit", "occurrences", zero("anchor_start"), zero("anchor_end"), "anchor_status", zero("start_line")
    )


@query(
    "overlapping_anchors",
    with_ctes(
        FILES_SQL, EDITS_SQL,
        select="""SELECT path, edit FROM (SELECT path, edit, anchor_start, lag(anchor_end) OVER (PARTITION BY proposal_id, path
                    ORDER BY anchor_start, anchor_end, edit) AS previous FROM placed WHERE anchor_status = 'unique' AND path NOT IN
                    (SELECT path FROM placed WHERE edit = 1 AND old_text = (SELECT any_value(p2.old_text) FROM placed p2 WHERE p2.path = placed.path AND p2.edit = 2)))
                  WHERE anchor_start < previous
                  UNION ALL SELECT path, 0 FROM placed GROUP BY path HAVING count(*) FILTER (WHERE anchor_status = 'unique') = 2 AND count(DISTINCT old_text) = 1""",
    ),
)
def overlapping_anchors(spark, sf_dir):
    """Second edit of each clashing pair; equal anchors are reported as edit 0."""
    anchors = located(spark, sf_dir)[0]
    same = anchors.groupBy("path").agg((F.count_distinct("old_text") == 1).alias("same"))
    return edits.overlapping_anchors(anchors).join(same, "path").select(
        "path", F.when(F.col("same"), 0).otherwise(F.col("edit")).alias("edit")
    )


@query(
    "file_scope",
    with_ctes(
        FILES_SQL, EDITS_SQL,
        select="""SELECT path, edit, CASE WHEN path LIKE 'es/%' THEN 'not_read' WHEN path LIKE 'fr/%' THEN 'not_indexed' ELSE 'allowed' END AS scope FROM edits""",
    ),
)
def file_scope(spark, sf_dir):
    """Spanish files were never read; French ones have left the index."""
    rows, files = document_edits(spark, sf_dir)
    reads = rows.where("path not like 'es/%'").select("proposal_id", "path")
    return edits.file_scope(rows, files.where("path not like 'fr/%'"), reads).select("path", "edit", "scope")


@query(
    "apply_edits",
    with_ctes(FILES_SQL, EDITS_SQL, select="SELECT path, length(updated) AS chars, md5(updated) AS updated_md5 FROM patched"),
)
def apply_edits(spark, sf_dir):
    return patched(spark, sf_dir).select("path", F.length("updated").alias("chars"), F.md5("updated").alias("updated_md5"))


@query("unified_diff")
def unified_diff(spark, sf_dir):
    pairs = patched(spark, sf_dir).select("change_id", "path", "original", "updated")
    return diffs.unified_diff(pairs).select("change_id", "path", F.length("diff").alias("diff_chars"), F.md5("diff").alias("diff_md5"))


def document_diffs(spark, sf_dir):
    pairs = patched(spark, sf_dir).select("change_id", "path", "original", "updated")
    return diffs.unified_diff(pairs)


# One line replaced and one added, so both counts are known without rendering a diff.
DIFF_COUNTS_SQL = """diff_counts AS (SELECT proposal_id AS change_id, path, 2 AS added, 1 AS removed FROM patched)"""


@query(
    "diff_lines",
    with_ctes(
        FILES_SQL, EDITS_SQL, DIFF_COUNTS_SQL,
        select="""SELECT p.proposal_id AS change_id, p.path, d.added, d.removed,
                         length(updated) - length(replace(updated, chr(10), '')) + 1 AS last_added_line
                  FROM patched p JOIN diff_counts d ON d.change_id = p.proposal_id""",
    ),
)
def diff_lines(spark, sf_dir):
    """Numbered rows, summed up per file: counts and the number of the last added line."""
    rows = diffs.diff_lines(document_diffs(spark, sf_dir))
    return rows.groupBy("change_id", "path").agg(
        F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "remove").alias("removed"),
        F.max(F.when(F.col("kind") == "add", F.col("right_line"))).alias("last_added_line"),
    )


@query("diff_stats", with_ctes(FILES_SQL, EDITS_SQL, DIFF_COUNTS_SQL, select="SELECT change_id, path, added, removed FROM diff_counts"))
def diff_stats(spark, sf_dir):
    return diffs.diff_stats(diffs.diff_lines(document_diffs(spark, sf_dir)))


@query(
    "verify_diff",
    with_ctes(
        FILES_SQL, EDITS_SQL,
        select="""SELECT proposal_id AS change_id, CASE proposal_id % 5 WHEN 0 THEN 'not_reproduced' WHEN 1 THEN 'no_change' WHEN 2 THEN 'invisible'
                         ELSE 'verified' END AS verdict FROM patched""",
    ),
)
def verify_diff(spark, sf_dir):
    """Diffs as rendered, except that some results are tampered with afterwards."""
    key = F.col("change_id")
    pairs = (
        document_diffs(spark, sf_dir)
        .withColumn(
            "updated",
            F.when(key % 5 == 0, F.concat("updated", F.lit("\nUnseen."))).when(key % 5 == 1, F.col("original")).otherwise(F.col("updated")),
        )
        .withColumn("diff", F.when(key % 5 == 2, "").otherwise(F.col("diff")))
    )
    return diffs.verify_diff(pairs).select("change_id", "verdict")


# ---- staleness ---------------------------------------------------------------

CHANGES_SQL = """changes AS (
  SELECT pos AS change_id, repository_id, path, sha, CASE WHEN pos % 4 = 0 THEN 'rejected' WHEN pos % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status FROM files)"""


@query(
    "stale_changes",
    with_ctes(
        FILES_SQL, EDITS_SQL, CHANGES_SQL,
        select="""SELECT c.change_id, coalesce(CASE WHEN status <> 'rejected' THEN
                    CASE WHEN substr(repository_id, 4)::INT % 4 = 1 AND change_id % 3 <> 0 THEN 'snapshot_moved'
                         WHEN change_id % 7 = 0 THEN 'file_changed' WHEN lost THEN 'anchor_lost' END END, '') AS stale_reason
                  FROM changes c JOIN (SELECT proposal_id, bool_or(anchor_status <> 'unique') AS lost FROM placed GROUP BY 1) a ON a.proposal_id = c.change_id""",
    ),
)
def stale_changes(spark, sf_dir):
    """Documents as changes: some repositories moved on, some files changed, some anchors are gone."""
    anchors, files = located(spark, sf_dir)
    key = F.col("pos")
    changes = files.select(
        key.alias("change_id"), "repository_id",
        F.when(key % 4 == 0, "rejected").when(key % 2 == 0, "approved").otherwise("proposed").alias("status"),
        F.when(key % 3 != 0, "c1").alias("indexed_commit_sha"),
    )
    number = F.substr("repository_id", F.lit(4)).cast("int")
    repositories = files.select("repository_id").distinct().select(
        "repository_id", F.when(number % 4 == 1, "c2").when(number % 4 != 2, "c1").alias("current_commit_sha")
    )
    pinned = files.select(
        key.alias("change_id"), "path", F.when(key % 7 == 0, "older").otherwise(F.col("blob_sha")).alias("blob_sha")
    )
    out = edits.stale_changes(changes, repositories, pinned, files, anchors)
    return out.select("change_id", F.coalesce("stale_reason", F.lit("")).alias("stale_reason"))


@query(
    "live_branch_check",
    with_ctes(
        FILES_SQL,
        select="""SELECT pos AS change_id, CASE WHEN pos % 3 = 0 OR (pos % 5 <> 0 AND path NOT LIKE 'de/%') THEN 'current' ELSE 'stale' END AS live_status,
                         CASE WHEN pos % 3 = 0 THEN 'c1' WHEN pos % 5 <> 0 AND path NOT LIKE 'de/%' THEN 'c2' ELSE '' END AS build_on FROM files""",
    ),
)
def live_branch_check(spark, sf_dir):
    """Heads moved for two changes in three; every fifth live file differs, German ones are gone."""
    files = document_files(spark, sf_dir)
    key = F.col("pos")
    changes = files.select(
        key.alias("change_id"), "repository_id", F.lit("c1").alias("base_sha"), F.when(key % 3 == 0, "c1").otherwise("c2").alias("head_sha")
    )
    pinned = files.select(key.alias("change_id"), "path", "blob_sha")
    live = files.where("path not like 'de/%'").select(
        "repository_id", "path", F.when(key % 5 == 0, "newer").otherwise(F.col("blob_sha")).alias("live_blob")
    )
    out = edits.live_branch_check(changes, pinned, live)
    return out.select("change_id", "live_status", F.coalesce("build_on", F.lit("")).alias("build_on"))


# ---- results -----------------------------------------------------------------

CASES = 10


def replies(spark, sf_dir):
    """Every conversation turn becomes the summary of a model reply; the turn decides its form."""
    rows = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    case = F.col("case")
    outcome = F.when(case == 4, "perhaps").when(case == 5, "insufficient_evidence").otherwise("change_proposed")
    payload = F.to_json(
        F.struct(
            outcome.alias("outcome"),
            F.col("text").alias("summary"),
            F.when(case == 6, "").otherwise(F.lit("because {x}")).alias("root_cause"),
            F.when(case == 7, "low").otherwise("high").alias("confidence"),
            F.array(F.struct(F.lit("a.py").alias("path"), F.lit("r").alias("reason"))).alias("relevant_files"),
            F.array(
                F.struct(F.when(case == 8, "S9").otherwise("[S1]").alias("source"), F.lit("claim").alias("claim")),
                F.struct(F.lit("S7").alias("source"), F.lit("claim").alias("claim")),
            ).alias("evidence"),
            F.when(
                case != 9,
                F.array(
                    F.struct(
                        F.lit("a.py").alias("path"), F.lit("old").alias("old_text"), F.lit("```\nnew\n```").alias("new_text"),
                        F.lit("why").alias("reason"),
                    )
                ),
            ).alias("proposed_changes"),
        )
    )
    keyed = rows.select(key.alias("investigation_id"), "text", (F.length("text") % CASES).alias("case"))
    fenced = F.concat(F.lit("Example:\n```json\n{\"a\": 1}\n```\nResult:\n```json\n"), F.col("payload"), F.lit("\n```\n"))
    reply = (
        F.when(case == 1, F.concat(F.lit("Done. "), F.col("payload"), F.lit(" Bye.")))
        .when(case == 2, F.concat(F.lit("```json\n{\"outcome\": "), F.col("investigation_id").cast("string"), F.lit("\n```")))
        .when(case == 3, F.lit("No result at all."))
        .otherwise(fenced)
    )
    return keyed.withColumn("payload", payload).withColumn("reply", reply).select("investigation_id", "case", F.col("reply").alias("text"))


REPLIES_SQL = f"""replies AS (
  SELECT conv_id * 100 + turn AS investigation_id, length(text) % {CASES} AS kase, length(text) AS chars FROM conversations),
verdicts AS (
  SELECT *, CASE WHEN kase IN (2, 3) THEN 'no_result' WHEN kase = 4 THEN 'outcome' WHEN chars > 2000 THEN 'summary' END AS invalid FROM replies)"""


def validated(spark, sf_dir):
    return results.validate_results(results.extract_json(replies(spark, sf_dir)))


def evidence_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("investigation_id"), F.lit("S1").alias("label"), F.lit("a.py").alias("path")
    )


def grounded(spark, sf_dir):
    return results.ground_results(validated(spark, sf_dir), evidence_rows(spark, sf_dir))


@query(
    "extract_json",
    with_ctes(REPLIES_SQL, select="SELECT investigation_id, kase NOT IN (2, 3) AS found, CASE WHEN kase IN (2, 3) THEN 0 ELSE chars END AS summary_chars FROM replies"),
)
def extract_json(spark, sf_dir):
    out = results.extract_json(replies(spark, sf_dir))
    return out.select(
        "investigation_id", F.col("payload").isNotNull().alias("found"),
        F.coalesce(F.length(F.get_json_object("payload", "$.summary")), F.lit(0)).alias("summary_chars"),
    )


@query(
    "validate_results",
    with_ctes(REPLIES_SQL, select="SELECT investigation_id, coalesce(invalid, '') AS invalid FROM verdicts"),
)
def validate_results(spark, sf_dir):
    return validated(spark, sf_dir).select("investigation_id", F.coalesce("invalid", F.lit("")).alias("invalid"))


GROUNDED_SQL = """grounded AS (
  SELECT investigation_id, kase, CASE WHEN kase = 8 THEN 0 ELSE 1 END AS resolved, CASE WHEN kase = 8 THEN 2 ELSE 1 END AS unresolved_citations,
    CASE WHEN kase = 9 THEN 'no_edits' WHEN kase = 6 THEN 'no_root_cause' WHEN kase = 8 THEN 'no_evidence' ELSE '' END AS error,
    CASE WHEN kase IN (5, 7) THEN 'insufficient_evidence' ELSE 'change_proposed' END AS outcome, kase NOT IN (5, 6, 7, 8, 9) AS may_patch
  FROM verdicts WHERE invalid IS NULL)"""


@query(
    "ground_results",
    with_ctes(REPLIES_SQL, GROUNDED_SQL,
              select="SELECT investigation_id, resolved, unresolved_citations, error, outcome, may_patch, 'a.py' AS known_files FROM grounded"),
)
def ground_results(spark, sf_dir):
    return grounded(spark, sf_dir).select(
        "investigation_id", "resolved", "unresolved_citations", F.coalesce("error", F.lit("")).alias("error"), "outcome",
        "may_patch", F.array_join("known_files", ",").alias("known_files"),
    )


@query(
    "change_report",
    with_ctes(
        FILES_SQL, EDITS_SQL, DIFF_COUNTS_SQL, REPLIES_SQL, GROUNDED_SQL,
        select="""SELECT g.investigation_id, g.outcome, coalesce(u.n, 0) AS anchors, CASE WHEN d.change_id IS NULL THEN 0 ELSE 1 END AS files,
                         coalesce(d.added, 0) AS added, d.change_id IS NOT NULL AND d.change_id % 5 <> 0 AS diff_verified
                  FROM grounded g LEFT JOIN (SELECT proposal_id, count(*) AS n FROM placed WHERE anchor_status = 'unique' GROUP BY 1) u ON u.proposal_id = g.investigation_id
                  LEFT JOIN diff_counts d ON d.change_id = g.investigation_id""",
    ),
)
def change_report(spark, sf_dir):
    """Replies grounded above, with the edits of the document that has the same number.

    The text of every fifth change goes on behind what its diff says.
    """
    anchors, files = located(spark, sf_dir)
    applied = edits.apply_edits(anchors, files).withColumn("change_id", F.col("proposal_id"))
    pairs = diffs.unified_diff(applied.select("change_id", "path", "original", "updated"))
    stats = diffs.diff_stats(diffs.diff_lines(pairs))
    altered = F.when(F.col("change_id") % 5 == 0, F.concat("updated", F.lit("more"))).otherwise(F.col("updated"))
    verdicts = diffs.verify_diff(pairs.withColumn("updated", altered))
    report = results.change_report(grounded(spark, sf_dir), anchors, stats, applied, verdicts)
    files_of = F.coalesce(F.col("report.files"), F.array())
    return report.select(
        "investigation_id", F.col("report.outcome").alias("outcome"),
        F.col("report.validation.anchors_matched_exactly_once").alias("anchors"), F.size(files_of).alias("files"),
        F.aggregate(files_of, F.lit(0).cast("bigint"), lambda acc, f: acc + f["added"]).alias("added"),
        F.col("report.validation.diff_verified").alias("diff_verified"),
    )
