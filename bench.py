"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names (default: the headline set)
BENCH_RUNS    timed runs per query, the best one counts (default 2)

Every query first runs once on the smallest tables, untimed, to load classes and workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from counterpoise.queries import QUERIES  # noqa: E402

HEADLINE = [
    "q_smote", "q_smote_over100", "q_smote_random", "q_smote_lineitem", "q_smote_multiclass",
    "q_smote_tomek", "q_knn_euclidean", "q_knn_manhattan", "q_knn_embeddings", "q_nn1",
    "q_knn_cells", "q_tomek_clean", "q_tomek_report", "q_tomek_orders", "q_encode", "q_minmax",
    "q_encode_docs", "q_class_counts", "q_sample_replicate", "q_dist_euclidean", "q_row_key",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(os.path.normpath(folder)), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small):
            run(spark, name, small)
        times[name] = round(min(run(spark, name, folder) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf")}))


if __name__ == "__main__":
    main()
