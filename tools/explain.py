"""Summarise the physical plans of registered queries (default: the bench headline set) as
Markdown: scans with their columns and pushed filters, joins, exchanges, windows, Python.

    python tools/explain.py [sf_dir] [name ...] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from unievents.plans.registry import QUERIES  # noqa: E402
from unievents.session import get_spark  # noqa: E402


def summary(plan: str) -> list[str]:
    nodes = Counter(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|"
                               r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)|WindowGroupLimit|"
                               r"Window|HashAggregate|SortAggregate|Generate|MapInArrow|MapInPandas)\b", plan))
    scans = Counter(f"`{m[1]}`" + (f", pushed {m[0]}" if m[0] else "")
                    for m in re.findall(r"PushedFilters: \[([^\]]*)\], ReadSchema: struct<([^>]*)>", plan))
    return ["- nodes: " + ", ".join(f"{n} {k}" for k, n in sorted(nodes.items())),
            *(f"- {n} x scan of {s[:300]}" for s, n in scans.most_common())]


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    names = [a for a in args if not os.path.isdir(a)] or HEADLINE
    spark = get_spark("local[8]")
    print(f"# Physical plans ({os.path.basename(sf_dir)}, before adaptive re-planning)\n\n"
          "Made by `tools/explain.py`; `df.explain(\"formatted\")` shows a plan in full. What a checkpoint has run before (R1's candidates, the sorted rows of listings) is not in them.\n")
    for name in names:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        print(f"## {name}\n\n" + "\n".join(summary(plan)) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
