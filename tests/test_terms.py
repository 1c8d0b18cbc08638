import pytest
from pyspark.sql import functions as F

from textquarry.functions import terms

IDENTIFIERS = {
    "get_db": ["getdb", "get", "db"],
    "useMemo": ["usememo", "use", "memo"],
    "HTTPException": ["httpexception", "http", "exception"],
    "sqlite3": ["sqlite3", "sqlite"],
    "h264": ["h264", "264"],
    "parseJSON": ["parsejson", "parse", "json"],
    "$": [],
    "_": [],
    "plain": ["plain"],
    "Is": ["is"],
}


def test_identifier_terms(spark):
    rows = spark.createDataFrame([(k,) for k in IDENTIFIERS], "word string")
    got = {r.word: r.t for r in rows.select("word", terms.identifier_terms(F.col("word")).alias("t")).collect()}
    assert got == IDENTIFIERS


@pytest.mark.parametrize(
    ("question", "expected", "identifiers"),
    [
        ("Where is useMemo used?", ["usememo", "use", "memo"], ["useMemo"]),
        ("what does get_db do", ["getdb", "get", "db"], ["get_db"]),
        ("How does SQLite work", ["sqlite"], []),
        ("see /analytics/operations.", ["see", "analytics", "operations"], ["analytics/operations"]),
        ("open App.jsx App.jsx", ["open", "app", "jsx"], ["App.jsx"]),
        ("für 42", ["f", "r", "42"], []),
        ("...", [], []),
    ],
)
def test_question_terms(spark, question, expected, identifiers):
    row = spark.createDataFrame([(question,)], "q string").select(
        terms.question_terms(F.col("q")).alias("t"), terms.question_identifiers(F.col("q")).alias("i")
    ).first()
    assert row.t == expected
    assert row.i == identifiers


def test_long_identifier_stays_whole(spark):
    row = spark.createDataFrame([("a" * 100,)], "q string").select(terms.text_terms(F.col("q")).alias("t")).first()
    assert row.t == ["a" * 100]


def test_identifier_terms_cover_every_word(spark, sf_dir):
    from textquarry import catalog

    found = catalog.QUERIES["identifier_terms_whole"](spark, sf_dir).where("form = 5")
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(size(regexp_extract_all(text, '[A-Za-z]+', 0)))")
    assert found.selectExpr("sum(words)").first()[0] == text.first()[0]


def test_joined_terms_are_those_of_each_word(spark):
    words = [*IDENTIFIERS, "aB1c", "ABc", "A1B2cc_d", "__x", "x_y", "", "9ab", "$a$", "HTTPServer2Go"]
    rows = spark.createDataFrame([(words,), ([],), (None,), (words[3:5],)], "w array<string>")
    one = F.transform("w", lambda w: F.array_join(terms.identifier_terms(w), " "))
    got = rows.select(terms.joined_terms(F.col("w")).alias("many"), one.alias("one")).collect()
    assert [r.many for r in got] == [r.one for r in got]


def test_words_of_a_text_are_split_many_at_once(spark, sf_dir):
    """A word's terms were found by interpreted patterns of its own: 3 000 seconds of eight cores for a GB."""
    from textquarry import catalog

    plan = catalog.QUERIES["identifier_terms"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan


def test_text_terms_with_and_without_breaks(spark):
    texts = ["The plain words, of prose", "getDb of sqlite3 in a_b", "A AB aB", "", None, "3ab ü !", "_ $"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in rows.orderBy("i").select(terms.text_terms(F.col("t")).alias("t")).collect()]
    assert got == [["the", "plain", "words", "of", "prose"], ["getdb", "get", "db", "of", "sqlite3", "sqlite", "in", "ab"],
                   ["a", "ab", "ab"], [], [], ["ab"], []]


def test_preview_line_keeps_digits_at_the_ends(spark):
    from textquarry.functions import text

    rows = spark.createDataFrame([("0 sum is 100",), ("# no\n1 and 11\n",), ("  \n　 x \n",)], "t string")
    assert [r.p for r in rows.select(text.preview_line(F.col("t")).alias("p")).collect()] == ["0 sum is 100", "1 and 11", "x"]


def test_counted_terms_are_those_of_the_text(spark):
    texts = ["The plain words, the prose", "getDb of sqlite3 in a_b\n_x", "A AB aB", "", None, "99 3ab ü !9", "_ $", "é"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select(terms.text_terms(F.col("t")).alias("t"), terms.counted_terms(F.col("t")).alias("c")).collect()
    for r in found:
        assert r.c.total == len(r.t)
        assert {c.term: c.tf for c in r.c.counts} == {t: r.t.count(t) for t in r.t} and len(r.c.counts) == len(set(r.t))


def test_a_query_writes_the_index_tables_it_reads(spark, sf_dir):
    """All tables were built for a query that reads one of them."""
    import os

    from textquarry.catalog.base import CorpusTables

    tables = CorpusTables(spark, sf_dir)
    assert tables.chunks.count() > 0 and os.listdir(tables.path) == ["chunks"]
    assert tables.term_counts.count() > 0 and sorted(os.listdir(tables.path)) == ["chunks", "postings", "term_counts"]
