"""Benchmark: run the registered queries on ``$BENCH_SF_DIR`` and print one JSON line.

Each query is executed to completion (``count`` of its result after a
``noop`` write would skip Python collection, so the result is written with the
``noop`` sink, which runs the whole plan). Times are wall-clock seconds.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from repolens.plans.registry import REGISTRY  # noqa: E402
from repolens.plans.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="repolens-bench",
                        checkpoint_dir=tempfile.mkdtemp(prefix="repolens-bench-"))
    # warm-up (not timed): JVM start, first scans and code generation, on the smallest tables
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ["changelog_windows", "active_runs", "support_window"]:
            REGISTRY[name].run(spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name, reg in REGISTRY.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        reg.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
