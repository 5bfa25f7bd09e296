"""Time the headline queries; prints one JSON line.

Each query is executed in full into a no-op sink. The first run warms the JVM and is
not counted; the reported time is the median of the rest. Model training runs once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.catalog import REGISTRY  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = [
    "information_value", "woe_fit_numeric", "woe_transform_categorical", "woe_transform_numeric",
    "target_encoding_out_of_fold", "smart_encoding", "column_profile", "feature_metadata", "feature_cleaning",
    "binarize_median", "stratified_split", "stratified_folds", "assembled_features", "all_metrics", "roc_curve",
    "ks_curve", "lift_by_decile", "cumulative_gains", "psi_matrix", "drift_report", "psi_by_day",
    "percentile_position", "quantile_decile", "rolling_statistics", "lagged_values", "linear_contributions",
    "model_agnostic_contributions", "local_explanations", "streaming_psi_by_day", "trained_model_metrics",
]


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINE:
        slow = 1 if name.startswith("trained_") else runs  # five full presets; the JVM is warm by then
        if slow > 1:
            timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(slow)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
