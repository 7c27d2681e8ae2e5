"""Summarise the physical plan of every catalogue query (``explain("formatted")``).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles, join strategies, aggregate kinds, window limits, scans with
pushed filters, and Python operators, one row per query.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evalspark.plans import catalog  # noqa: E402
from evalspark.session import get_spark  # noqa: E402

COUNT = [
    ("shuffles", r"^\(\d+\) Exchange$"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"^\(\d+\) SortMergeJoin"),
    ("hash agg", r"^\(\d+\) HashAggregate"),
    ("obj agg", r"^\(\d+\) ObjectHashAggregate"),
    ("sort agg", r"^\(\d+\) SortAggregate"),
    ("window limit", r"^\(\d+\) WindowGroupLimit"),
    ("python", r"^\(\d+\) (ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas\w*|BatchEvalPython)"),
]


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    out = {name: sum(1 for ln in lines if re.search(rx, ln.strip())) for name, rx in COUNT}
    scans = sum(1 for ln in lines if re.match(r"^\(\d+\) Scan parquet", ln.strip()))
    pushed = sum(1 for ln in lines if ln.startswith("PushedFilters: [") and ln.strip() != "PushedFilters: []")
    out["scans (pushed filters)"] = f"{scans} ({pushed})"
    out["cross"] = sum(1 for ln in lines if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", ln))
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    rows = []
    for name, fn in catalog.QUERIES.items():
        if name.startswith("stream_"):
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf).explain("formatted")
        rows.append((name, summarise(buf.getvalue())))
    cols = list(rows[0][1])
    print("# Physical plans of the catalogue queries\n")
    print(f"`python tools/plan_report.py {sf}`: counts per query from `explain(\"formatted\")` "
          "(before AQE re-planning; AQE may turn shuffle joins into broadcast joins at run time). "
          "Streaming queries are left out.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---:|" * len(cols))
    for name, r in rows:
        print(f"| `{name}` | " + " | ".join(str(r[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
