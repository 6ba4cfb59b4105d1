"""Headline timings: one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose the data and the cores.  Each query runs in
full through a sink that discards rows, so nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from creditloom.workload import all_queries

HEADLINE = [
    "hist_window_basic",
    "hist_numeric_aggs",
    "beh_dpd",
    "beh_recovery",
    "beh_slopes",
    "beh_volatility",
    "hist_summary",
    "latest_snapshot",
    "numeric_aggs",
    "rolling_means",
    "trends",
    "time_since_event",
    "feature_factory",
    "default_detection",
    "merge_left_dedup",
    "quantiles",
    "prep_full",
    "woe_table",
    "woe_encode",
    "mutual_information",
    "feature_diagnostics",
    "metric_report",
    "lift_curve",
    "psi_report",
    "fairness_report",
    "blend_weights",
    "split_quantile",
    "cv_group_folds",
    "dataset_job",
    "evaluation_report",
    "champion_scores",
    "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("creditloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("count(*)").collect()
    names = sys.argv[1:] or HEADLINE
    run = all_queries()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
