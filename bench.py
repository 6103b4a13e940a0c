"""Benchmark: run headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query's full plan is executed through the ``noop`` sink (no collect, no column
pruning of the result).  Times are the median wall-clock seconds of $BENCH_RUNS (3) runs after a
warm-up of the workers.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ragtide.plans.registry import load_all  # noqa: E402
from ragtide.session import get_session  # noqa: E402

HEADLINE = [
    "topk_exact", "topk_l2", "topk_ivf_all", "source_details", "assemble_context",
    "extract_elements", "assemble_documents", "chunk_fixed", "chunk_recursive", "embed_hashing",
    "rag_retrieve", "retrieval_recall", "judge_scores", "evaluation_rows", "quality_gates",
    "changed_documents", "reindex_replace", "ingest_batch", "exact_duplicates",
    "daily_quality", "drift_ks", "column_summary", "drift_alerts", "qa_pairs", "session_report",
    "stream_daily_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]")
    reg = load_all()
    # warm-up: JVM code paths and the Python worker pool (excluded from the timings)
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(64, numPartitions=int(cpus)).mapInPandas(lambda it: it, "id long").collect()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            t0 = time.time()
            reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        times[name] = round(statistics.median(took), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else None,
    }))


if __name__ == "__main__":
    main()
