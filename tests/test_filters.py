import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import paths
from textquarry.operators import filters
from textquarry.settings import IndexLimits


@pytest.mark.parametrize(
    ("path", "language"),
    [
        ("a/b.PY", "python"), ("README", "markdown"), ("x/Dockerfile", "text"), (".env", None), (".gitignore", None),
        ("conf/app.env", "text"), ("a.tar.gz", None), ("types.d.ts", "typescript"), ("LICENSE.md", "markdown"), ("noext", None),
    ],
)
def test_language(spark, path, language):
    row = filters.detect_language(spark.createDataFrame([(path,)], "path string")).first()
    assert row.language == language


@pytest.mark.parametrize(
    ("entry", "reason"),
    [
        (("node_modules/a.js", "blob", 5), "excluded_directory"), (("src/build.py", "blob", 5), None),
        (("a/yarn.lock", "blob", 5), "excluded_file"), (("app.min.js", "blob", 5), "excluded_file"),
        (("lib", "commit", None), "submodule"), (("lib", "tree", None), "unsupported_type"),
        (("a.png", "blob", 5), "unsupported_type"), (("a.py", "blob", None), "empty"), (("a.py", "blob", 600_000), "too_large"),
    ],
)
def test_metadata_reason(spark, entry, reason):
    rows = spark.createDataFrame([entry], "path string, type string, size bigint")
    assert filters.metadata_decision(rows, IndexLimits(max_file_bytes=512_000)).first().skip_reason == reason


@pytest.mark.parametrize(
    ("path", "allowed"),
    [
        ("src/app.py", True), ("/etc/passwd", False), ("../x", False), ("a/../b", False), ("C:/x", False), ("a\\b", False),
        ("a//b", False), ("./a", False), ("", False), (" src/a.py ", True), ("a" * 1001, False),
    ],
)
def test_path_scope(spark, path, allowed):
    row = spark.createDataFrame([(path,)], "path string").select(paths.in_repository_scope(F.col("path")).alias("ok")).first()
    assert row.ok == allowed


def brute_budget(files, limits):
    left, count, out = limits.max_total_bytes, 0, {}
    for pos, size in sorted(files):
        if count >= limits.max_files:
            out[pos] = "file_limit_reached"
        elif size > left:
            out[pos] = "byte_budget_reached"
        else:
            left, count, out[pos] = left - size, count + 1, None
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shape", ["random", "descending", "mixed"])
def test_budget_equals_walk(spark, seed, shape):
    """The bounded candidate set must give the same verdict as walking over everything."""
    generator = random.Random(seed)
    sizes = [generator.randint(1, 4_000) for _ in range(1_500)]
    if shape == "descending":
        sizes.sort(reverse=True)
    if shape == "mixed":
        sizes = [s if i % 3 else s * 40 for i, s in enumerate(sizes)]
    limits = IndexLimits(max_total_bytes=60_000, max_files=40 + 400 * (seed % 2))
    files = [(generator.randint(0, 2**18) * 2_000 + i, size) for i, size in enumerate(sizes)]
    rows = spark.createDataFrame([("r", p, s) for p, s in files], "repository_id string, pos bigint, size bigint")
    got = {r.pos: r.skip_reason for r in filters.apply_budgets(rows, limits).collect()}
    assert got == brute_budget(files, limits)


def test_content_reasons(spark):
    rows = spark.createDataFrame(
        [(1, bytearray(b"ok\n")), (2, bytearray(b"a\x00b")), (3, bytearray(b"\xff\xfe")), (4, bytearray(b" \n\t")),
         (5, bytearray(b"x" * 8_000 + b"\x00"))],
        "id int, content binary",
    )
    got = {r.id: r.skip_reason for r in filters.content_decision(rows).collect()}
    assert got == {1: None, 2: "binary", 3: "decode_failed", 4: "empty", 5: None}
