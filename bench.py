"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import re
import time

from textquarry import catalog
from textquarry.catalog.base import corpus_index
from textquarry.session import local_session

HEADLINE = (
    "chunk_by_lines",
    "chunk_files",
    "build_postings",
    "hashed_embeddings",
    "apply_budgets",
    "lexical_search",
    "cosine_top_k",
    "ann_top_k",
    "candidate_pool",
    "hybrid_search",
    "near_duplicate_matches",
    "render_context",
    "read_ranges",
    "find_symbol",
    "register_evidence",
    "unread_ranges",
    "verify_diff",
    "stale_changes",
    "workflow_state",
    "review_transitions",
    "assemble_answers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()  # start-up
    times: dict[str, float] = {}
    began = time.perf_counter()
    corpus_index(spark, sf_dir)
    times["build_index"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
