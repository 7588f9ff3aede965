"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs
once to warm up and then twice; the better time counts. Results go to a no-op sink, so all
rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from lossweave.registry import QUERIES

HEADLINE = [
    "P9_prepare_records",
    "A1_quality_counters",
    "A11_dataset_hash",
    "A2_W6_duplicate_ordinals",
    "M6_T2_F10_keyword_search",
    "M2_J9_T1_nearest_claims",
    "M10_W4_T3_search",
    "A9_W2_cluster_keywords",
    "M13_cluster_summary",
    "A4_J2_T4_cluster_overview",
    "A6_cluster_financials",
    "M15_T8_unusual_claims",
    "M11_kmeans",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
