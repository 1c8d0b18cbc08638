"""Cutting by spans computes the arrays of a file once, not once per element."""

from textquarry.catalog import chunks as catalog
from textquarry.operators import chunking


def test_arrays_are_not_computed_again_in_functions_of_elements(spark, sf_dir):
    frame = catalog.emit_symbols(spark, sf_dir)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("encode(") <= 2 and plan.count("coalesce(_packed") <= 1


def test_children_are_found_by_the_span_that_follows(spark):
    spans = [(0, 40, "a"), (2, 20, "b"), (4, 6, "c"), (8, 12, "d"), (22, 30, "e"), (40, 50, "f")]
    row = ("r", "p", "python", "x" * 50, [(s, e, "class", "class", n, None) for s, e, n in spans])
    frame = spark.createDataFrame([row], f"repository_id string, path string, language string, content string, spans array<{chunking.SPAN}>")
    nodes = chunking._nodes(frame, catalog.IndexLimits(max_chunk_chars=1)).first()["_nodes"]
    assert [(n["span"]["name"], n["scope"], n["has_children"]) for n in nodes] == [
        ("a", -1, True), ("b", 0, True), ("c", 1, False), ("d", 1, False), ("e", 0, False), ("f", -1, False)
    ]
