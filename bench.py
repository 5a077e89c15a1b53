"""Time registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

After one warm-up query each query is timed once, while every row is produced and dropped.
``python bench.py name ...`` times the named queries only.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "search_topk", "reference_search", "snippet_windows", "build_plans", "aggregate_findings", "traceability_problems", "parse_hunks",
    "ruff_reports", "planner_metrics", "ground_citations", "completion_rate", "issue_metrics", "issue_metrics_by_tool", "quality_savings",
    "coverage_report", "minimum_contract", "fill_slots", "claims_covered", "context_windows", "select_evidence", "truncate_evidence",
    "vector_topk", "python_symbols", "resolve_symbols", "callee_edges", "call_graph", "active_jobs", "job_status", "report_lines",
    "versioned_upsert", "coverage_matrix", "recover_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from revgrain.plans import catalog
    from revgrain.session import local_session

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        run = catalog.QUERIES[name]
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
