"""Headline timings: ordering, scoring and routing; windows; detector fold; evaluation tables.

Prints one JSON line. Every query starts from the raw tables: staged intermediate tables are
forgotten before each run, so their cost is part of the figure.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tidegauge.plans.evaluation  # noqa: E402,F401  (registers its queries)
from tidegauge.plans import catalog, events  # noqa: E402
from tidegauge.session import build_session, ship_package  # noqa: E402

HEADLINES = (
    "flagship", "causal_order", "normalize_running", "window_features_continuous", "sliding_windows", "adwin",
    "closed_loop_trace", "pre_post_metrics", "routing_metrics", "latency_summary", "fit_statistics_flow",
    "exact_quantiles", "time_axis_report", "dataset_audit", "drift_absorption", "eligible_count_asof",
)
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            # A few megabytes in all: keep them spread over the cores instead of packed into one task.
            "spark.sql.files.openCostInBytes": "65536",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()  # start the JVM's threads
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",") if n]
    seconds = {}
    for name in names:
        runs = []
        for _ in range(REPEATS):
            events.forget()
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs) if len(runs) < 3 else statistics.median(runs), 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"), "events": rows,
                "closed_loop_rows_per_second": round(25 * rows / 2 / seconds["closed_loop_trace"]) if "closed_loop_trace" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
