"""What near-duplicates compare and keep: parts of sets, groups of nodes, no shuffle files of written tables."""

import random
import time

import numpy as np
import pyarrow as pa

from textquarry.operators import near_duplicates
from textquarry.session import SHUFFLE_CLEANUP, cut_lineage


def parts_of(sets, threshold):
    tokens = pa.array([[hash((t, "x")) for t in s] for s in sets], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(len(sets))], pa.binary()), tokens], ["node", "tokens"])
    found = [set() for _ in sets]
    for out in near_duplicates._listed(threshold)(iter([batch])):
        for part, node in zip(out["part"].to_pylist(), out["node"].to_pylist()):
            found[int(node)].add(part)
    return found


def test_sets_at_the_threshold_share_a_part():
    rng = random.Random(1)
    for threshold in (0.5, 0.8, 0.9, 1.0):
        sets = []
        for n in [*range(1, 60), 90, 171, 400]:
            base = rng.sample(range(100_000), n)
            least = next(k for k in range(n + 1) if k / n >= threshold)
            sets += [base, base[:least]]  # the smallest similar subset
            union = int(n / threshold)
            sets += [base, base + [f"new{i}" for i in range(union - n)] if n / max(union, 1) >= threshold else base]
            both = next(k for k in range(n + 1) if k / (2 * n - k) >= threshold)
            sets += [base, base[:both] + [f"own{i}" for i in range(n - both)]]
        found = parts_of(sets, threshold)
        assert all(found[i] & found[i + 1] for i in range(0, len(sets), 2))


def test_size_ranges_hold_both_sets_of_a_similar_pair():
    firsts, _ = near_duplicates.size_ranges(3_000, 0.9)
    place = np.searchsorted(firsts, np.arange(1, 3_001), "right")
    for n in range(1, 2_600):
        largest = max(m for m in range(n, n * 10 // 9 + 2) if n / m >= 0.9)
        assert place[largest - 1] - place[n - 1] <= 1


def test_common_words_bring_no_sets_together(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", " ".join(f"w{rng.randrange(150)}" for _ in range(120))) for i in range(600)]
    rows += [("same", rows[0][1]), ("near", rows[1][1] + " more")]
    _, nodes = near_duplicates.token_nodes(spark.createDataFrame(rows, "chunk_id string, content string"))
    facts = nodes.select("node", "copies", "n", "tokens").mapInArrow(near_duplicates._sketched, "node binary, copies bigint, n int, sketch binary")
    groups = near_duplicates.near_groups(nodes, facts.dropDuplicates(["node"]), 0.9)
    assert groups.count() <= 6  # 600 sets from one small vocabulary, of which two are near copies


def test_a_written_table_leaves_no_shuffle_files(spark):
    kept = spark._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {f.getName() for f in map(kept.getAllFiles().apply, range(kept.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before = names()
    rows = cut_lineage(spark.range(10_000).repartition(7, "id").groupBy("id").count())
    for _ in range(50):
        if not names() - before:
            break
        time.sleep(0.2)
    assert not names() - before and rows.count() == 10_000 and spark.conf.get(SHUFFLE_CLEANUP, None) is None
