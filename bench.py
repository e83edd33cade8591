"""Benchmark: every registered query at one scale factor, cold and warm.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name-prefix ...]

Each query is executed to completion with the ``noop`` sink (all rows
computed, nothing collected). Prints one JSON line: ``value`` is the sum of
warm times; ``queries`` the warm time per query, ``cold`` the first run.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from scholargraph.plans import catalog
    from scholargraph.session import get_session

    spark = get_session(f"local[{cpus}]", partitions=max(cpus, 8))
    spark.sparkContext.setLogLevel("OFF")
    names = [n for n in sorted(catalog.QUERIES) if not argv or any(n.startswith(p) for p in argv)]
    cold, warm, errors = {}, {}, {}
    for name in names:
        fn = catalog.QUERIES[name]
        for store in (cold, warm):
            t0 = time.perf_counter()
            try:
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as e:  # keep going; report the failure
                errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
                break
            store[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "sum_warm_query_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "n_queries": len(warm),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1:])
