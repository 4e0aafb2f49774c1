"""Times the headline queries and prints one JSON line.

Each query runs once to warm up code generation and file listings and is then
timed; the result is written to the no-op sink so that every row is computed.
Set BENCH_COLD=1 to time the first run instead.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritab.catalogue import QUERIES  # noqa: E402
from veritab.session import build_session  # noqa: E402

HEADLINE = [
    "profile_numeric", "profile_missing", "distinct_counts", "value_counts_top10", "type_inference", "duplicates",
    "imbalance", "outlier_report", "quality_score", "correlation_matrix", "drop_null_rows", "fill_mean", "fill_median",
    "fill_mode", "outlier_iqr_multi", "outlier_zscore", "scale_standard", "label_encode", "one_hot", "cleaning_chain",
    "pii_scan", "dataset_characteristics", "latest_operation", "cache_lookup", "stratified_split", "roc_points_by_range",
    "class_metrics", "variance_importance", "knn_predict", "dbscan_labels", "silhouette_exact", "logistic_regression",
    "kmeans",
]


def run(name: str, spark, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        first = run(name, spark, folder)
        seconds[name] = round(first if os.environ.get("BENCH_COLD") else run(name, spark, folder), 3)
        print(f"{name}: first {first:.2f} s, timed {seconds[name]:.2f} s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
