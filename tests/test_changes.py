import difflib
import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import secrets
from textquarry.operators import citations, diffs, edits, lookup, results

EDIT = "proposal_id string, repository_id string, path string, old_text string, new_text string"
FILE = "repository_id string, path string, blob_sha string, content string"


def files(spark, content):
    return spark.createDataFrame([("r", "a.py", "s", content)], FILE)


@pytest.mark.parametrize(
    ("content", "old", "status"),
    [("a\nb\na\n", "b", "unique"), ("a\nb\na\n", "a", "ambiguous"), ("a\n", "z", "not_found"), ("aaaa", "aa", "ambiguous"), ("x\r\ny\r\n", "x\ny", "unique")],
)
def test_anchors(spark, content, old, status):
    rows = spark.createDataFrame([("p", "r", "a.py", old, "n\nm")], EDIT)
    got = edits.locate_anchors(rows, files(spark, content)).first()
    assert got.anchor_status == status
    if "\r\n" in content:
        assert got.replacement == "n\r\nm"


def test_edits_are_order_independent_and_overlaps_refused(spark):
    content = "one\ntwo\nthree\nfour\n"
    good = spark.createDataFrame([("p", "r", "a.py", "three", "3"), ("p", "r", "a.py", "one\ntwo", "1\n2\n2")], EDIT)
    source = files(spark, content)
    out = edits.apply_edits(edits.locate_anchors(good, source), source).first()
    assert out.updated == "1\n2\n2\n3\nfour\n"
    bad = spark.createDataFrame([("p", "r", "a.py", "one\ntwo", "x"), ("p", "r", "a.py", "two\nthree", "y")], EDIT)
    located = edits.locate_anchors(bad, source)
    assert edits.overlapping_anchors(located).count() == 1
    assert edits.apply_edits(located, source).count() == 0


def test_every_rendered_diff_verifies_and_tampering_shows(spark):
    generator = random.Random(5)
    rows = []
    for i in range(30):
        old = [generator.choice("abcdef") for _ in range(generator.randint(1, 30))]
        new = list(old)
        for _ in range(generator.randint(1, 4)):
            at = generator.randrange(len(new) + 1)
            new[at : at + generator.randint(0, 2)] = [f"n{at}"] * generator.randint(0, 2) or ["z"]
        rows.append((i, "f.py", "\n".join(old), "\n".join(new)))
    pairs = diffs.unified_diff(spark.createDataFrame(rows, "change_id bigint, path string, original string, updated string"))
    verdicts = {r.change_id: r for r in diffs.verify_diff(pairs).collect()}
    for i, _, old, new in rows:
        assert verdicts[i].verdict == ("no_change" if old == new else "verified"), (old, new)
        expected = list(difflib.unified_diff(old.splitlines(), new.splitlines(), "a/f.py", "b/f.py", lineterm=""))
        assert verdicts[i].diff == "\n".join(expected)
    changed = pairs.where(F.col("original") != F.col("updated"))
    tampered = changed.withColumn("original", F.concat(F.lit("other\n"), "original"))
    assert {r.verdict for r in diffs.verify_diff(tampered).collect()} <= {"context_mismatch", "not_reproduced"}


def test_content_that_looks_like_a_header(spark):
    old = "a\n-- a/x\nselect 1\n-- b\nz"
    new = "a\n++ b/y\nselect 2\n-- b\nz\n@@ -1 +1 @@"
    pairs = spark.createDataFrame([(1, "q.sql", old, new), (2, "r.sql", new, old)], "change_id bigint, path string, original string, updated string")
    for context in (0, 3):
        rendered = diffs.unified_diff(pairs, context)
        assert {r.verdict for r in diffs.verify_diff(rendered).collect()} == {"verified"}
        assert {(r.change_id, r.path, r.added, r.removed) for r in diffs.diff_stats(diffs.diff_lines(rendered)).collect()} == {
            (1, "q.sql", 3, 2), (2, "r.sql", 2, 3),
        }


@pytest.mark.parametrize(
    ("diff", "verdict"),
    [
        ("@@ -1,2 +1,2 @@\n one\n-two\n+2", "verified"),
        ("@@ -1,2 +1,2 @@\n one\n-two\n+2\n\\ No newline at end of file", "verified"),
        ("@@ -1,2 +1,2 @@\n ONE\n-two\n+2", "context_mismatch"),
        ("@@ -1,3 +1,3 @@\n one\n-two\n+2", "malformed"),
        ("@@ -1,2 +1,2 @@\n one\n*two\n-two\n+2", "malformed"),
        ("@@ -1,2 +1,2 @@\n one\n-two\n+2\n@@ -2 +2 @@\n-two\n+2", "overlapping"),
        ("@@ -1,2 +1,2 @@\n one\n-two\n+3", "not_reproduced"),
        ("", "invisible"),
    ],
)
def test_verdicts_of_diffs(spark, diff, verdict):
    whole = f"--- a/f\n+++ b/f\n{diff}" if diff else ""
    rows = [(1, "f", "one\ntwo", "one\n2", whole)]
    pairs = spark.createDataFrame(rows, "change_id bigint, path string, original string, updated string, diff string")
    assert diffs.verify_diff(pairs).first().verdict == verdict


def test_citations(spark):
    answers = spark.createDataFrame([("m", "claimed [S7]. Seen [S1, S9] and [S2].")], "message_id string, content string")
    sources = spark.createDataFrame([("m", "S1"), ("m", "S2")], "message_id string, label string")
    row = citations.resolve_citations(answers, sources).first()
    assert row.content == "claimed. Seen [S1] and [S2]."
    assert (row.cited, row.resolved, row.unresolved) == (["S7", "S1", "S9", "S2"], 2, 2)


def test_unread_ranges(spark):
    reads = spark.createDataFrame([("i", "a", 40, 50), ("i", "a", 1, 10), ("i", "a", 5, 20), ("i", "a", 45, 47)], "investigation_id string, path string, start_line int, end_line int")
    totals = spark.createDataFrame([("i", "a", 60), ("i", "b", 3)], "investigation_id string, path string, total_lines int")
    got = sorted((r.path, r.unread_start, r.unread_end) for r in lookup.unread_ranges(reads, totals).collect())
    assert got == [("a", 21, 39), ("a", 51, 60), ("b", 1, 3)]


def test_secrets(spark):
    token = "gh" + "p_" + "a" * 36
    rows = spark.createDataFrame(
        [(1, "a.py", f"x = '{token}'"), (2, ".env", "A=1"), (3, ".env.example", "KEY="), (4, "app.py", "def f(): pass"),
         (5, "id_rsa", "-----BEGIN RSA " + "PRIVATE KEY-----\nabc")],
        "id int, path string, t string",
    )
    got = {r.id: r.k for r in rows.select("id", secrets.secret_kinds(F.col("t"), F.col("path")).alias("k")).collect()}
    assert got == {1: ["a GitHub token"], 2: [secrets.ENV_FILE], 3: [], 4: [], 5: ["a private key"]}
    clean = rows.select(secrets.redact(F.col("t")).alias("t")).collect()
    assert all(token not in r.t for r in clean)


@pytest.mark.parametrize(
    ("reply", "summary"),
    [
        ('```json\n{"summary": "s", "outcome": "x"}\n```', "s"),
        ('first\n```json\n{"a": 1}\n```\nthen\n```json\n{"summary": "two"}\n```\n', "two"),
        ('bare {"summary": "b {x}"} end', "b {x}"),
        ('first {"summary": "one"} then {"summary": "two", "root_cause": "{"} and {"other": 1}', "two"),
        ('```json\n{"summary": "s"}\nthat was it\n```', "s"),
        ('```json\n{"summary": "code ```x``` inside"}\n```', "code ```x``` inside"),
        ('{"summary": ', None),
        ("nothing", None),
    ],
)
def test_extract_json(spark, reply, summary):
    row = results.extract_json(spark.createDataFrame([(reply,)], "text string")).first()
    got = spark.createDataFrame([(row.payload,)], "p string").select(F.get_json_object("p", "$.summary").alias("s")).first().s
    assert got == summary


def test_find_symbol_treats_wildcards_literally(spark):
    chunks = spark.createDataFrame(
        [("1", "r", "a.py", 1, "create_session", None, "x"), ("2", "r", "a.py", 9, "create_session_token", None, "y"), ("3", "r", "b.py", 1, "createXsession", "Pool", "z")],
        "chunk_id string, repository_id string, path string, start_line int, symbol string, parent_symbol string, content string",
    )
    names = spark.createDataFrame([("n1", "r", "create_session"), ("n2", "r", "po"), ("n3", "r", "%")], "request_id string, repository_id string, name string")
    got = sorted((r.request_id, r.match_rank, r.chunk_id) for r in lookup.find_symbol(names, chunks).collect())
    assert got == [("n1", 1, "1"), ("n1", 2, "2"), ("n2", 1, "3")]
