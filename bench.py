"""Bench: wall seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the no-op sink (every row is
produced, nothing is collected to the driver). Untimed warm-up queries
on the smallest tables warm the JVM, codegen caches and imports first. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callsheet.plans import spark_queries  # noqa: E402
from callsheet.session import get_session  # noqa: E402

HEADLINE = [
    "scan_clients", "segment_rate", "describe_numeric", "value_counts", "crosstab_pivot", "corr_matrix",
    "dense_counts", "distribution_by_class", "common_features", "group_measures", "measure_table",
    "split_stratified", "standardize", "one_hot", "gaussian_nb", "nearest_centroid", "qda", "voting_hard",
    "confusion_ratios", "classification_report", "two_layer", "call_hours", "tradeoff",
    "univariate_logit", "formula_logit", "logistic_regression", "random_forest_importance",
    "svd_variance", "kmeans_segments", "gower_to_landmarks", "dbscan_2d",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", partitions=cpus, app="callsheet-bench")
    qs = spark_queries()
    # warm-up (JIT, codegen caches, Python imports) on the smallest tables
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = warm_dir if os.path.isdir(warm_dir) else sf_dir
    for name in ("segment_rate", "describe_numeric", "gaussian_nb", "kmeans_segments"):
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.catalog.clearCache()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus,
                      "config": {"shuffle_partitions": cpus, "aqe": True, "master": f"local[{cpus}]"}}))
    spark.stop()


if __name__ == "__main__":
    main()
