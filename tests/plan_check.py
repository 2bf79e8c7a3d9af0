"""Plans of all registered queries: no pair joins, no Python in the hot path, no global window.

``python tests/plan_check.py [sf_dir]``
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "CollectLimit")


def findings(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [b for b in BAD if b in plan]
    if re.search(r"Window \[.*\], \[[^\]]*\]\n", plan) and re.search(r"Window \[[^\n]*\], \[[a-z_#0-9]+ (?:ASC|DESC)[^\n]*\]\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", plan):
        found.append("global window")
    return found


if __name__ == "__main__":
    import __spark_entry__ as entry
    from vakanz.session import get_session

    spark = get_session("plans", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    for name, fn in entry.queries().items():
        if name.startswith("stream"):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        note = findings(df)
        print(f"{name:26s} exchanges={plan.count('Exchange hash'):<3d} single={plan.count('Exchange SinglePartition'):<2d} bcast={plan.count('BroadcastExchange'):<2d} windows={len(re.findall('Window ', plan)):<2d} limit={plan.count('WindowGroupLimit'):<2d} {note}")
