"""Benchmark: run every registered report at one test scale and print one
JSON line with per-query wall seconds (median of BENCH_RUNS warm runs).

Each query is executed in full with the ``noop`` sink (all stages run,
nothing is collected to the driver).

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (default 3), BENCH_QUERIES (comma list, default all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetscope import registry  # noqa: E402
from fleetscope.session import ensure_checkpoint_dir, local_session  # noqa: E402
from fleetscope.workspace import release_all  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, max(cpus, 8), app="fleetscope-bench")
    ensure_checkpoint_dir(spark)
    qs = registry.queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(qs)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        fn = qs[name]
        samples = []
        for i in range(runs + 1):  # first run warms the JVM and file caches
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                samples.append(time.perf_counter() - t0)
            release_all()
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
