"""Time Spark's own evaluators on the inputs of the headline curve queries.

They give the two areas only, one pass each; the queries of ``bench.py`` give the areas,
both maxima and their points at once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.evaluation import BinaryClassificationEvaluator  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402

from plumbscore.catalog.curves import scored_lines  # noqa: E402
from plumbscore.catalog.deployment import scored_events  # noqa: E402
from plumbscore.session import build_session  # noqa: E402


def areas(df: DataFrame) -> None:
    """Both areas without binning."""
    for metric in ("areaUnderROC", "areaUnderPR"):
        BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", metricName=metric, numBins=0).evaluate(df)


def areas_by_day(df: DataFrame) -> None:
    """Both areas of every day and model, one after the other."""
    keyed = df.withColumn("date", df.ts.cast("date"))
    for row in keyed.select("date", "model").distinct().collect():
        areas(keyed.where((keyed.date == row.date) & (keyed.model == row.model)))


def main() -> None:
    """Print one JSON line of medians."""
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench-mllib", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {
        "binary_metrics": lambda: areas(scored_lines(spark, folder)),
        "binary_metrics_fine": lambda: areas(scored_lines(spark, folder, "l_extendedprice")),
        "window_auc": lambda: areas_by_day(scored_events(spark, folder)),
    }
    seconds = {}
    for name, job in jobs.items():
        taken = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            job()
            taken.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "mllib_seconds", "queries": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
