"""Time the queries and print one JSON line.

Environment: BENCH_SF_DIR (input tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per
query, the median counts), BENCH_QUERIES (comma-separated names; all but the slow model
queries by default).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from broadsheet.queries import QUERIES
from broadsheet.session import local_session

# Each trains models anew; train_predict stands for them.
LEFT_OUT = {"model_quality", "classify_routed", "train_file_chinese"}


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    named = os.environ.get("BENCH_QUERIES", "")
    names = [n for n in named.split(",") if n] or [n for n in QUERIES if n not in LEFT_OUT]

    spark = local_session(cores, "bench")
    times: dict[str, float] = {}
    for name in names:
        timed(QUERIES[name], spark, sf_dir)  # warm-up
        took = statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(runs))
        times[name] = round(took, 3)
        print(f"{name} {took:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
