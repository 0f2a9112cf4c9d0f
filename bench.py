"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run to the last row into a sink that discards it. Queries that read
gold tables share one warehouse per session; its build is measured as ``warehouse_build``.
``BENCH_QUERIES`` (comma-separated) limits the run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hodos.registry import QUERIES, incremental_of, warehouse_of  # noqa: E402
from hodos.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()

    def clocked(action) -> float:
        start = time.perf_counter()
        action()
        return round(time.perf_counter() - start, 3)

    shared = {
        "shared_warehouse": clocked(lambda: warehouse_of(spark, sf_dir)),
        "shared_incremental": clocked(lambda: incremental_of(spark, sf_dir)),
    }
    seconds = {}
    for name in names:
        seconds[name] = clocked(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(seconds.values()) + sum(shared.values()), 3)
    line = {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "setup": shared, "sf": found.group(1) if found else sf_dir}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
