"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from tideglass.plans import registry

NAMES = ["panel_build", "metrics_basic", "metrics_full", "clean_panel", "features", "wf_schedule", "wf_equity", "cpcv_sharpe", "benchmarks_6040", "gain_actions", "text_sentiment"]

#: A query's time is the median of so many runs after a warm-up.
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        registry.QUERIES[name](spark, sf_dir).count()  # compiled and cached by the system once
        spark.catalog.clearCache()
        runs = []
        for _ in range(RUNS):
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(runs), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
