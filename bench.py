"""Headline-query benchmark.

Runs the flagship and headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed in full through the no-op sink (every row produced, nothing
collected to the driver). One trivial job on ``spark.range`` runs first so JVM/JIT
start-up is not charged to the first query; it touches no test data and caches nothing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "r1_recommend_top10",      # R1 flagship
    "r2_recommend_summary",    # R2
    "r4_list_events",          # R4
    "r5_filter_events",        # R5
    "r6_event_detail",         # R6
    "p1_page_text",            # P1
    "r8_link_frontier",        # R8
    "r9_load_event_responses", # R9
    "r10_subject_lists",       # R10
    "w1_upsert_events_log",    # W1
    "r3_events_for_subject",   # R3
    "r11_import_subjects",     # R11
    "w4_set_event_categories", # W4
    "m6_page_event_items",     # M6
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("UNIEVENTS_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2)))
    from unievents.plans.registry import QUERIES
    from unievents.session import get_spark

    spark = get_spark(f"local[{cpus}]")
    spark.range(100_000).selectExpr("sum(id)").collect()  # JVM warm-up, no test data
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
