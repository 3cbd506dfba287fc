"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (regex).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from memlake.plans import all_queries  # noqa: E402
from memlake.session import build_session  # noqa: E402

HEADLINE = [
    "S2_append_counts", "P5_triage", "A1_journal_stats", "A8_conversation_features", "A24_thread_rollup", "W2_time_gap_windows", "W7_failure_streaks",
    "C2_heuristic_policy", "C9_merge_threads", "F6_extract_date", "L1_current_state", "L6_duplicate_hints", "G3_duplicate_groups", "G6_connected_components",
    "G9_retract_facts", "G10_snapshot_facts", "J10_newest_at_expiry", "R1_lexical_top20", "R2_bm25_top10", "R3_vector_knn", "R4_rrf_fusion", "R5_expand_to_notes",
    "R6_project_inference", "R9_context_rows", "R11_eval_leaks", "E3_policy_sweep", "S10_parse_sections", "ST2_idempotent_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", cpus, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    names = [n for n in HEADLINE if not wanted or re.search(wanted, n)]
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executors
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
