"""Benchmark the registered queries.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``; a warm-up pass over all queries, then per query one
warm-up and the median of ``$BENCH_REPEATS`` (default 5) runs, each forced through the ``noop`` sink
so the whole result is computed without collecting it. Prints one JSON
line; ``value`` is the sum of the medians of the headline queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waterbook import catalog  # noqa: E402
from waterbook.session import build_session  # noqa: E402

HEADLINE = [
    "region_sectioned_report",
    "region_ytd_growth",
    "class_period_growth",
    "arrears_snapshot",
    "reading_delta",
    "trip_overlaps",
    "flush_volume",
]


def run_once(build, spark, sf_dir) -> float:
    """Seconds to build and analyse the DataFrame and compute all its rows."""
    t0 = time.perf_counter()
    df = build(spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else list(catalog.QUERIES)
    spark = build_session(
        "waterbook-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        extra_conf={
            "spark.driver.memory": "8g",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
            # keep the driver's status store small over hundreds of runs
            "spark.sql.ui.retainedExecutions": "20",
            "spark.ui.retainedJobs": "100",
            "spark.ui.retainedStages": "100",
            "spark.ui.retainedTasks": "2000",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # JVM warm-up (class loading, JIT of the planner and codegen paths):
    # one pass over every selected query before anything is timed
    for name in names:
        run_once(catalog.QUERIES[name], spark, sf_dir)
    times: dict[str, float] = {}
    for name in names:
        build = catalog.QUERIES[name]
        run_once(build, spark, sf_dir)  # warm-up
        runs = [run_once(build, spark, sf_dir) for _ in range(repeats)]
        times[name] = round(statistics.median(runs), 4)
    headline = [n for n in HEADLINE if n in times] or list(times)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_queries_total_median",
        "value": round(sum(times[n] for n in headline), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "headline": headline,
        "cpus": cpus,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
