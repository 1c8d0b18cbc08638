"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check import TABLES, normal

QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, database, name):
    frame = QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    if name not in ORACLE:
        assert rows
        return
    result = database.execute(ORACLE[name])
    assert normal(frame.columns, rows) == normal([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", ["chunk_by_lines", "build_postings", "metadata_decision", "chunk_files", "rrf"])
def test_hot_path_stays_in_the_engine(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_chunks_and_postings_need_no_shuffle_of_text(spark, sf_dir):
    from textquarry.catalog.base import table
    from textquarry.operators import chunking, filters, lexical
    from textquarry.sources import files

    source = filters.detect_language(files.documents_as_files(table(spark, sf_dir, "documents")))
    postings = lexical.build_postings(chunking.chunk_by_lines(source))
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
