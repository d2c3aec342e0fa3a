"""Champions, drift, A/B tests, splits and lookups."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbscore.operators.nearest import nearest
from plumbscore.plans import deployment
from plumbscore.plans.deployment import (
    ab_compare,
    ab_rates,
    baseline_silhouette,
    canary,
    champion,
    hedge_splits,
    long_metrics,
    metric_documents,
    metrics_of_counts,
    window_counts,
    window_metrics,
)


def daily(spark, rows):
    """Rows of (day, model, auc) as a metric table."""
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, d), m, v) for d, m, v in rows], "date timestamp_ntz, model string, auc double"
    )


def test_champion_ties_gaps_and_nulls(spark):
    metrics = daily(spark, [(1, "b", 0.7), (1, "a", 0.7), (2, "a", 0.1), (2, "b", None), (5, "b", 0.9), (5, "a", 0.8)])
    got = [tuple(r)[1:] for r in champion(metrics).orderBy("date").collect()]
    assert got == [("a", 0.7, None), ("a", 0.1, "a"), ("b", 0.9, "a")]


def test_hedge_splits(spark):
    metrics = daily(spark, [(d, m, v) for d in (1, 2, 3) for m, v in (("a", 0.9), ("b", 0.6))])
    got = {(r.date.day, r.model): r.split for r in hedge_splits(metrics, eta=2.0).collect()}
    assert got[1, "a"] == got[1, "b"] == 0.5
    for day in (1, 2, 3):
        assert got[day, "a"] + got[day, "b"] == pytest.approx(1)
        assert got[day, "a"] / got[day, "b"] == pytest.approx(math.exp(2 * 0.3 * (day - 1)))


def test_hedge_splits_do_not_overflow(spark):
    metrics = daily(spark, [(d, m, v) for d in range(1, 29) for m, v in (("a", 1.0), ("b", 0.0))])
    last = {r.model: r.split for r in hedge_splits(metrics, eta=1000.0).where("day(date) = 28").collect()}
    assert last == {"a": 1.0, "b": 0.0}


def test_ab_compare(spark):
    rows = [("a", i < 30) for i in range(100)] + [("b", i < 50) for i in range(100)] + [("d", True)]
    rates = ab_rates(spark.createDataFrame(rows, "model string, hit boolean"), F.col("hit"), [])
    got = {(r.model_a, r.model_b): r for r in ab_compare(rates, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6
    pair = got["a", "b"]
    assert pair.difference == pytest.approx(-0.2) and pair.significant
    assert pair.z == pytest.approx(-0.2 / math.sqrt(0.4 * 0.6 * 0.02))
    assert got["a", "c"].z is None and got["c", "d"].significant is None
    assert got["b", "d"].z is not None


def test_window_metrics_equal_metrics_of_summed_counts(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    scored = events.select(
        "event_id", "ts", F.lit("m").alias("model"), (F.pmod("user_id", F.lit(10)) / 10).alias("score"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("y"),
    )
    whole = window_metrics(scored, "ts", "7 days")
    parts = [window_counts(scored.where(F.col("event_id") % 2 == i), "ts", "7 days") for i in (0, 1)]
    assert whole.exceptAll(metrics_of_counts(parts[0].unionByName(parts[1]))).count() == 0
    assert whole.count() > 3


def test_scores_of_windows_are_grouped_once(spark, folder, monkeypatch):
    curve, plans = deployment.threshold_curve, []
    monkeypatch.setattr(deployment, "threshold_curve", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or curve(df, *a))
    events = spark.read.parquet(f"{folder}/events.parquet")
    rows = events.select("ts", F.lit("m").alias("model"), F.col("value").alias("score"), (F.col("user_id") % 2).alias("y"))
    found = window_metrics(rows, "ts", "1 day")
    assert len(plans) == 1 and plans[0].count("Aggregate [") == 1
    again = deployment.metrics_of_counts(deployment.window_counts(rows, "ts", "1 day"))
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_canary(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    near = [(start, c + rng.gauss(0, 0.1)) for c in (0, 10) for _ in range(20)]
    spread = [(start + dt.timedelta(days=1), rng.uniform(0, 10)) for _ in range(40)]
    alone = [(start + dt.timedelta(days=2), rng.gauss(0, 0.1)) for _ in range(5)]
    df = spark.createDataFrame(near + spread + alone, "ts timestamp_ntz, x double")
    centres = [[0.0], [10.0]]
    baseline = baseline_silhouette(df.where("day(ts) = 1"), ["x"], centres)
    got = canary(df, "ts", "1 day", ["x"], centres, baseline).orderBy("date").collect()
    assert [r.drifted for r in got] == [False, True, None]
    assert got[0].drift == pytest.approx(0) and got[1].drift < -0.1 and got[2].clusters == 1


def test_documents(spark):
    metrics = daily(spark, [(1, "a", 0.7), (1, "b", 0.6), (2, "a", 0.5)])
    canaries = daily(spark, [(1, "kmeans", 0.4)]).withColumnRenamed("auc", "silhouette")
    both = long_metrics(metrics, ["auc"]).unionByName(long_metrics(canaries, ["silhouette"]))
    got = [tuple(r)[1:] for r in metric_documents(both, ["a", "b"]).orderBy("date").collect()]
    assert got == [(0.4, 0.7, 0.6), (None, 0.5, None)]


def nearest_by_loop(probes, series):
    wanted = {}
    for name, key, at in probes:
        points = [(t, v) for k, t, v in series if k == key and v is not None]
        wanted[name] = min(((abs(at - t), t, v) for t, v in points), default=(None, None, None))[1:]
    return wanted


@pytest.mark.parametrize("rows_per_slice", [15, 100_000])
def test_nearest_with_hot_key_and_instant(spark, rows_per_slice):
    rng = random.Random(rows_per_slice)
    series = [
        (rng.choices(["hot", "a", None], [6, 2, 2])[0], rng.randint(0, 400), rng.choice([None, 1.0, 2.0, 3.0]))
        for _ in range(200)
    ]
    probes = [(i, rng.choices(["hot", "a", None, "none"], [6, 2, 1, 1])[0], rng.choice([200, rng.randint(-50, 450)])) for i in range(400)]
    got = nearest(
        spark.createDataFrame(probes, "id int, k string, t int"),
        spark.createDataFrame(series, "k string, t int, v double"),
        "t", "v", ["k"], rows_per_slice,
    )
    assert {r.id: (r.nearest_time, r.nearest_value) for r in got.collect()} == nearest_by_loop(probes, series)


def test_nearest_without_keys_or_series(spark):
    probes = spark.createDataFrame([(1, 5.0), (2, None)], "id int, t double")
    series = spark.createDataFrame([(4.0, 1.0), (6.0, 2.0)], "t double, v double")
    got = {r.id: (r.nearest_time, r.nearest_value) for r in nearest(probes, series, "t", "v").collect()}
    assert got == {1: (4.0, 1.0), 2: (None, None)}
    empty = nearest(probes, series.where("false"), "t", "v").collect()
    assert len(empty) == 2 and all(r.nearest_time is None for r in empty)


def test_a_missing_model_gains_half(spark):
    rows = [(1, "a", 0.7), (1, "b", 0.7), (2, "a", 0.5), (3, "a", 0.6), (3, "b", 0.6)]
    metrics = spark.createDataFrame(rows, "day int, model string, auc double").selectExpr("make_timestamp_ntz(2024, 1, day, 0, 0, 0) AS date", "model", "auc")
    found = {(r.date.day, r.model): (r.gain, r.split) for r in hedge_splits(metrics).collect()}
    assert len(found) == 6 and found[3, "b"][1] == pytest.approx(0.5)
    assert found[3, "a"][0] == pytest.approx(found[3, "b"][0]) == pytest.approx(1.2)
