"""Benchmark: time every registered query at one scale factor.

Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query's result is fully computed with the ``noop`` sink (no driver
collect), so the time is the distributed plan's time.
env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_ONLY (comma-separated query names), BENCH_HEADLINE=1 (headline only)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ordo.plans.session import build_session  # noqa: E402
from ordo.queries import load_all  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]
    headline_only = os.environ.get("BENCH_HEADLINE") == "1"
    spark = build_session(f"local[{cpus}]", cpus, app="ordo-bench")
    reg = load_all()
    # warm-up: JIT and parquet footer caches
    reg["agg_state_grouped"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name, q in reg.items():
        if only and name not in only:
            continue
        if headline_only and not q.headline:
            continue
        t0 = time.perf_counter()
        try:
            q.fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline": {k: v for k, v in times.items() if reg[k].headline},
        "sf": float(m.group(1)) if m else sf_dir,
        "n_queries": len(times),
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
