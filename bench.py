"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores, BENCH_RUNS the warm
runs per query (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbscore.catalog import QUERIES  # noqa: E402
from plumbscore.session import build_session  # noqa: E402

HEADLINES = [
    "binary_metrics",
    "binary_metrics_fine",
    "binary_metrics_by_many_keys",
    "roc_points",
    "silhouette_fixed_assignment",
    "silhouette_by_key",
    "feature_pipeline",
    "hash_split",
    "window_auc",
    "champion",
    "canary",
    "ab_compare",
    "bandit_splits",
    "nearest_metric_by_user",
    "train_evaluate_lr",
    "train_evaluate_rf",
    "train_evaluate_nn",
    "train_evaluate_kmeans",
    "stream_window_auc",
]


def main() -> None:
    """Run every headline query once cold and then ``BENCH_RUNS`` times."""
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        taken = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
