from pyspark.sql import functions as F

from textquarry.catalog.base import table
from textquarry.operators import lookup
from textquarry.plans import index as plan
from textquarry.plans import search
from textquarry.settings import IndexLimits
from textquarry.sources import files


def test_index_is_built_published_replaced_and_searched(spark, sf_dir, tmp_path):
    manifest = files.documents_as_files(table(spark, sf_dir, "documents"))
    limits = IndexLimits(max_chunk_lines=20)
    path = str(tmp_path / "index")
    plan.publish_index(plan.build_index(manifest, limits), path)
    stored = plan.load_index(spark, path)
    chunks = stored.chunks.count()
    assert chunks > 0
    assert stored.files.groupBy("repository_id", "blob_sha").count().where("count > 1").isEmpty()
    assert stored.embeddings.count() == chunks
    # Publishing one repository again replaces its rows and leaves the others alone.
    one = manifest.where("repository_id = 'src3'")
    before = {r.repository_id: r["count"] for r in stored.chunks.groupBy("repository_id").count().collect()}
    plan.publish_index(plan.build_index(one.where("path like 'en/%'"), limits), path)
    after = {r.repository_id: r["count"] for r in plan.load_index(spark, path).chunks.groupBy("repository_id").count().collect()}
    assert {k: v for k, v in after.items() if k != "src3"} == {k: v for k, v in before.items() if k != "src3"}
    assert 0 < after["src3"] <= before["src3"]
    # An emptied repository loses its rows.
    none = plan.build_index(one.where("false"), limits)
    plan.publish_index(none, path, plan.load_index(spark, path), replaced=one)
    assert plan.load_index(spark, path).chunks.where("repository_id = 'src3'").isEmpty()
    assert plan.load_index(spark, path).postings.where("repository_id = 'src3'").isEmpty()
    # A question quoting a stored chunk finds it, within its own repository only.
    stored = plan.load_index(spark, path)
    asked = stored.chunks.select(F.col("chunk_id").alias("query_id"), "repository_id", F.left("content", F.lit(400)).alias("text"))
    result = search.hybrid_search(asked, stored.chunks, stored.postings, stored.embeddings)
    top = result.candidates.where("fused_rank <= 3").join(asked.select("query_id", F.col("repository_id").alias("own")), "query_id")
    assert top.where("own <> repository_id").isEmpty()
    found = top.where("query_id = chunk_id").count()
    assert found >= 0.8 * asked.count()


def test_labels_are_numbered_across_blocks(spark):
    rows = [("i", s, f"f{s % 40}", 1, 2, None, "x") for s in range(100)] + [("j", 7, "f", 1, 2, None, "x")]
    spans = spark.createDataFrame(
        rows, "investigation_id string, seq bigint, path string, start_line int, end_line int, symbol string, origin string"
    )
    got = {(r.investigation_id, r.path): r.label for r in lookup.register_evidence(spans, block=8).collect()}
    assert got == {**{("i", f"f{n}"): f"S{n + 1}" for n in range(40)}, ("j", "f"): "S1"}


def test_a_file_that_cannot_be_read_keeps_its_row(spark, tmp_path):
    root = tmp_path / "a b%20c"
    for name in ("good", "bad"):
        spark.createDataFrame([(f"{name} text",)], "value string").coalesce(1).write.text(str(root / name))
    broken = next((root / "bad").glob("part-*.txt"))  # its checksum no longer fits
    broken.write_bytes(b"BAD TEXT\n")
    manifest = files.scan_files(spark, str(root), "r", "*.txt").withColumn("pos", F.monotonically_increasing_id())
    got = {r["path"]: (r["content"] and bytes(r["content"]), r["size"], r["skip_reason"]) for r in manifest.collect()}
    good = next((root / "good").glob("part-*.txt"))
    assert got == {f"good/{good.name}": (b"good text\n", 10, None), f"bad/{broken.name}": (None, 9, "unreadable")}
    decided = {r["path"]: r["skip_reason"] for r in plan.select_files(manifest).collect()}
    assert decided == {f"good/{good.name}": None, f"bad/{broken.name}": "unreadable"}
