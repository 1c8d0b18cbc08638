import duckdb

from textquarry.catalog import ORACLE, QUERIES


def test_every_text_and_language_comes_back_from_the_files(spark, tmp_path):
    texts = ["", None, "a b", "a\nb", "a\\nb", "a\\sb", "a\\\nb", "\\", "\n", "\r\n", "+", "-", " ", "a\x00b", "a\nb", ""]
    langs = ["en", "EN", "pt-BR", "", None, "a/b", "x%20=y", "none", "zh\n"]
    rows = [(len(langs) * t + n, text, lang, "src1", None) for t, text in enumerate(texts) for n, lang in enumerate(langs)]
    rows += [(9_000, None, "nulls", "src1", None), (None, "no id", "en", None, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["scan_files"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(con.execute(ORACLE["scan_files"]).fetchall())
    assert len(got) == len(langs) + 1
