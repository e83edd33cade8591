"""Print the physical plan of registered queries, or a one-line summary of each.

    python -m scholargraph.plans.explain [--sf DIR] [--full] [name-prefix ...]

The summary counts what matters at scale: Parquet scans (and whether they
push filters), shuffle exchanges, broadcast, sort-merge and nested-loop
joins, windows and window group limits (use ``--full`` for the formatted
plan with its codegen spans).
"""
from __future__ import annotations

import argparse
import re


def summarize(plan: str) -> dict[str, int]:
    return {
        "scans": len(re.findall(r"Scan parquet", plan)),
        "pushed_filters": len(re.findall(r"PushedFilters: \[[^\]]", plan)),
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition", plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "nested_loop_joins": plan.count("NestedLoopJoin"),
        "windows": len(re.findall(r"\bWindow\b", plan)),
        "group_limits": plan.count("WindowGroupLimit"),
    }


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--full", action="store_true", help="print the formatted plan")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from scholargraph.plans import catalog
    from scholargraph.session import get_session

    spark = get_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    for name in sorted(catalog.QUERIES):
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        df = catalog.QUERIES[name](spark, a.sf)
        if a.full:
            print(f"== {name} ==")
            df.explain("formatted")
        else:
            plan = df._jdf.queryExecution().executedPlan().toString()
            print(name, summarize(plan), flush=True)


if __name__ == "__main__":
    main()
