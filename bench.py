"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quillon.session import local_session
from quillon.suite import REGISTRY

HEADLINE = [
    "bm25_search", "dense_search", "hybrid_search", "guideline_search", "passage_retrieval_metrics",
    "chunk_labels", "document_chunks", "compressed_passages", "name_decisions",
    "catalogue_merge", "name_search", "sections_markdown", "page_blocks",
    "due_reminders", "low_stock", "call_utterances", "call_snapshots", "latency_summary",
    "idle_sessions", "index_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    REGISTRY["latency_summary"].job(spark, sf_dir).collect()  # start the engine once
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].job(spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(name, round(time.perf_counter() - start, 2), file=sys.stderr, flush=True)
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
