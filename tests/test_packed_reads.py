"""What is read of packed postings: statistics take names of terms, vectors take terms as they are stored."""

from test_stretches import corpus

from textquarry.operators import lexical
from textquarry.plans import index as plan


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_postings_are_read_without_functions_of_elements(spark, tmp_path):
    chunks, postings, _, asked = corpus(spark, tmp_path)
    stats = lexical.term_statistics(postings, chunks, asked)
    assert "tf_names" not in executed(stats) and "tf_body > 0" not in executed(stats)
    assert "lambda" not in executed(plan.chunk_vectors(postings))
    plain = lexical.term_statistics(lexical.unpacked(postings), chunks, asked)
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, plain.collect()))
    rows = plan.chunk_vectors(lexical.unpacked(postings))
    assert sorted(map(tuple, plan.chunk_vectors(postings).collect())) == sorted(map(tuple, rows.collect()))
