"""Streams and monitors: restarts, replays, late rows, and control."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from plumbscore.catalog.deployment import bought
from plumbscore.catalog.streams import run_monitor
from plumbscore.operators.sampling import assign
from plumbscore.plans import deployment
from plumbscore.plans.deployment import metrics_of_counts, window_metrics
from plumbscore.plans.training import fit
from plumbscore.session import materialize, scratch_path, work_dir
from plumbscore.sources.files import LoadSpec
from plumbscore.sources import metric_store
from plumbscore.sources.metric_store import all_metrics
from plumbscore.streaming import monitor as monitoring
from plumbscore.streaming.monitor import Monitor, model_scorer, start, start_sampling
from plumbscore.streaming.streams import csv_stream, event_time, parquet_stream, score_counts, start_counts, stop


def scored(df):
    return df.select("ts", F.lit("m").alias("model"), (F.pmod("user_id", F.lit(10)) / 10).alias("score"), bought().alias("y"))


def test_stream_of_chunks_equals_batch_on_closed_windows(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("s-source", "s-sink", "s-check"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        events.where(F.dayofmonth("ts").between(low, high)).coalesce(1).write.mode("append").parquet(source)
        stream = event_time(parquet_stream(spark, source, events.schema), "ts")
        counts = score_counts(scored(stream), "ts", "1 day", "1 hour")
        start_counts(counts, sink, checkpoint).awaitTermination()
    stored = spark.read.parquet(sink).withColumn("date", F.col("date").cast("timestamp_ntz"))
    streamed = metrics_of_counts(stored)
    last = events.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("last")).first()["last"]
    batch = window_metrics(scored(events), "ts", "1 day").where(F.col("date") < F.lit(last.isoformat()).cast("timestamp_ntz"))
    assert batch.count() >= 28
    assert batch.exceptAll(streamed).count() == 0 and streamed.exceptAll(batch).count() == 0


def test_late_rows_are_dropped(spark):
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("l-source", "l-sink", "l-check"))
    schema = "ts timestamp, model string, score double, y double"
    for day in ("2024-01-01", "2024-01-05", "2024-01-01", "2024-01-09"):
        rows = spark.createDataFrame([(day, 0.5, 1.0)], "t string, score double, y double")
        rows.select(F.col("t").cast("timestamp").alias("ts"), F.lit("m").alias("model"), "score", "y").write.mode(
            "append"
        ).parquet(source)
        stream = parquet_stream(spark, source, spark.createDataFrame([], schema).schema)
        start_counts(score_counts(stream, "ts", "1 day", "1 hour"), sink, checkpoint).awaitTermination()
    got = [(str(r.date)[:10], r.p) for r in spark.read.parquet(sink).orderBy("date").collect()]
    assert got == [("2024-01-01", 1), ("2024-01-05", 1)]


def monitor_input(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select("event_id", "ts", "user_id", "value", bought().alias("y"), F.col("value").alias("x"))


def scorers():
    return {
        "good": lambda df: df.withColumn("score", F.col("y") + F.pmod("event_id", F.lit(7)) / 4),
        "poor": lambda df: df.withColumn("score", F.pmod("event_id", F.lit(7)) / 7),
        "kmeans": lambda df: df,
    }


@pytest.mark.parametrize("mode", ["champion", "abtesting", "multiarm"])
def test_replayed_batches_change_nothing(spark, folder, mode):
    store = scratch_path(spark, f"replay-{mode}")
    monitor = Monitor(mode, scorers(), store, "event_id", "ts", canary=[[10.0], [100.0]], canary_features=["x"])
    rows = monitor_input(spark, folder)
    for batch in (0, 1, 1, 2):
        monitor.process(rows.where(F.col("event_id") % 3 == batch), batch)
    monitor.process(rows.where("false"), 3)
    assert monitor._earlier(rows, 4) == monitor._earlier(rows, 3)
    before = sorted(map(tuple, all_metrics(spark, store, mode).collect()))
    monitor.process(rows.where(F.col("event_id") % 3 == 1), 1)
    stored = all_metrics(spark, store, mode)
    assert sorted(map(tuple, stored.collect())) == before
    assert {r.batch for r in stored.collect()} == {0, 1, 2}
    assert stored.where("metric = 'silhouette'").count() == 3
    values = {(r.batch, r.model, r.metric): r.value for r in stored.collect()}
    assert all(values[b, "good", "auc"] > values[b, "poor", "auc"] for b in range(3))
    if mode == "champion":
        assert [(r.batch, r.model) for r in stored.where("metric = 'champion'").orderBy("batch").collect()] == [
            (1, "good"), (2, "good"),
        ]
    else:
        for b in range(3):
            assert values[b, "good", "split"] + values[b, "poor", "split"] == pytest.approx(1)
    if mode == "multiarm":
        shares = [values[b, "good", "split"] for b in range(3)]
        assert shares[0] == 0.5 and shares[0] < shares[1] < shares[2]
        assert values[2, "good", "gain"] == pytest.approx(sum(values[b, "good", "auc"] for b in range(3)))


def test_splits_explore_and_ignore_scale():
    monitor = Monitor("multiarm", {"a": None, "b": None}, "x", "k", "t", eta=100.0, explore=0.2)
    shares = monitor.splits({"a": 1000.0, "b": 0.0})
    assert shares == pytest.approx({"a": 0.9, "b": 0.1})


def test_monitor_arguments():
    with pytest.raises(ValueError, match="unknown mode"):
        Monitor("other", {"a": None}, "x", "k", "t")
    with pytest.raises(ValueError, match="take traffic"):
        Monitor("champion", {"kmeans": None}, "x", "k", "t")
    with pytest.raises(ValueError, match="one weight"):
        Monitor("abtesting", {"a": None, "b": None}, "x", "k", "t", weights=[1])
    with pytest.raises(ValueError, match="positive sum"):
        Monitor("abtesting", {"a": None, "b": None}, "x", "k", "t", weights=[0, 0])


def test_fitted_models_and_canary_in_a_monitor(spark, folder):
    rows = monitor_input(spark, folder).withColumn("label", F.col("y")).withColumn("hint", F.col("y") * 2 + F.rand(1))
    models = {n: fit(n, rows, columns=["hint", "x"], **p) for n, p in (("logisticRegression", {}), ("randomForest", {"numTrees": 5, "seed": 1}))}
    clusters = fit("kmeans", rows, columns=["x"], k=2, seed=1)
    store = scratch_path(spark, "fitted")
    named = {n: model_scorer(m, 1) for n, m in models.items()}
    Monitor("champion", named, store, "event_id", "ts", canary=clusters, canary_features=["x"]).process(rows, 0)
    values = {(r.model, r.metric): r.value for r in all_metrics(spark, store, "champion").collect()}
    assert values["randomForest", "auc"] > 0.95 and values["logisticRegression", "auc"] > 0.9
    assert 0.3 < values["kmeans", "silhouette"] < 1


def test_one_scan_for_all_models(spark, folder):
    rows = materialize(monitor_input(spark, folder))
    three = {**scorers(), "third": lambda df: df.withColumn("score", F.col("x"))}
    monitor = Monitor("champion", three, "unused", "event_id", "ts")
    routed = rows.withColumn("model", F.when(F.col("event_id") % 2 == 0, "good").otherwise("third"))
    for scored_rows in (monitor._scored(rows), monitor._scored(routed, routed=True)):
        assert scored_rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert monitor._scored(rows).count() == 3 * rows.count()
    expected = routed.select("model", F.when(F.col("model") == "third", F.col("x")).otherwise(
        F.col("y") + F.pmod("event_id", F.lit(7)) / 4).alias("score"), "y")
    found = monitor._scored(routed, routed=True)
    assert found.count() == rows.count() and found.exceptAll(expected).isEmpty()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("mode", ["abtesting", "multiarm"])
def test_a_routed_row_is_hashed_once(spark, folder, monkeypatch, mode):
    rows, read = monitor_input(spark, folder), []
    routed = assign(rows, "event_id", ["a", "b", "c"], [1, 1, 2])
    assert optimized(routed).count("md5(") == 1 and routed.columns == [*rows.columns, "model"]
    measure = monitoring.binary_metrics
    monkeypatch.setattr(monitoring, "binary_metrics", lambda df, **k: read.append(optimized(df.where("score > 0"))) or measure(df, **k))
    store = scratch_path(spark, f"hashed-{mode}")
    Monitor(mode, scorers(), store, "event_id", "ts").process(rows, 0)
    assert len(read) == 1 and "md5(" not in read[0]
    assert all_metrics(spark, store, mode).where("metric = 'auc'").count() == 2


def test_features_of_a_baseline_are_derived_once(spark, folder, monkeypatch):
    rows, read = monitor_input(spark, folder).withColumn("z", F.get_json_object(F.format_string('{"k": %s}', "x"), "$.k").cast("double")), []
    measure = deployment.silhouette
    monkeypatch.setattr(deployment, "silhouette", lambda df, *k: read.append(optimized(df.where("prediction IS NOT NULL"))) or measure(df, *k))
    found = deployment.baseline_silhouette(rows, ["z", F.col("x") * 2], [[10.0, 20.0], [100.0, 200.0]])
    assert len(read) == 1 and "get_json_object" not in read[0]
    placed = deployment.place(rows.withColumn("twice", F.col("x") * 2), ["z", "twice"], [[10.0, 20.0], [100.0, 200.0]])
    assert found == pytest.approx(measure(placed, ["z", "twice"], "prediction").first()["silhouette"], abs=1e-9)


def test_batches_leave_no_scratch_and_few_files(spark, folder, monkeypatch, tmp_path):
    mode = "abtesting"
    for module in (metric_store, monitoring):
        monkeypatch.setattr(module, "SPAN", 2)
    rows = materialize(monitor_input(spark, folder).limit(60), "leak-input")
    store = str(tmp_path / "store")
    monitor = Monitor(mode, scorers(), store, "event_id", "ts", canary=[[10.0], [100.0]], canary_features=["x"])
    local = work_dir(spark).removeprefix("file:")
    before = set(os.listdir(local))
    for batch in range(6):
        monitor.process(rows, batch)
    assert set(os.listdir(local)) == before
    assert sorted(n for n in os.listdir(f"{store}/{mode}/recent") if "batch" in n) == ["batch=4", "batch=5"]
    assert sorted(n for n in os.listdir(f"{store}/{mode}/closed") if "span" in n) == ["span=0", "span=1"]
    stored = all_metrics(spark, store, mode)
    assert {r.batch for r in stored.collect()} == set(range(6))
    counted = stored.groupBy("batch", "model", "metric").count()
    assert counted.where("count > 1").isEmpty()
    rows_before = sorted(map(tuple, stored.collect()))
    monitor.process(rows, 4)  # replayed, compaction included
    assert sorted(map(tuple, all_metrics(spark, store, mode).collect())) == rows_before


def test_a_replayed_batch_replaces_the_closed_one(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(metric_store, "SPAN", 2)

    def rows(value):
        return spark.createDataFrame([(1, "m", "auc", value)], "seq bigint, model string, metric string, value double").withColumn(
            "date", F.lit("2024-01-01").cast("timestamp_ntz"))

    store = str(tmp_path)
    for batch in range(5):
        metric_store.append_metrics(rows(batch / 10), store, "champion", batch)
    metric_store.compact_metrics(spark, store, "champion", 1)
    assert len(os.listdir(f"{store}/champion/recent")) >= 5
    metric_store.compact_metrics(spark, store, "champion", 4)
    metric_store.append_metrics(rows(0.9), store, "champion", 1)
    for _ in range(2):
        found = {r.batch: r.value for r in all_metrics(spark, store, "champion").collect()}
        assert found == {0: 0.0, 1: 0.9, 2: 0.2, 3: 0.3, 4: 0.4}
        metric_store.compact_metrics(spark, store, "champion", 4)


def test_drift_and_comparison_are_stored(spark, folder, tmp_path):
    rows = monitor_input(spark, folder)
    names = {k: v for k, v in scorers().items()}
    monitor = Monitor("abtesting", names, str(tmp_path), "event_id", "ts", canary=[[10.0], [100.0]], canary_features=["x"],
                      baseline=0.0, tolerance=0.2, converted="x > 20")
    monitor.process(rows, 0)
    values = {(r.model, r.metric): r.value for r in all_metrics(spark, str(tmp_path), "abtesting").collect()}
    assert values["kmeans", "drift"] == values["kmeans", "silhouette"] > 0.2 and values["kmeans", "drifted"] == 1
    assert values["good", "n"] + values["poor", "n"] == rows.count()
    assert values["good", "conversions"] + values["poor", "conversions"] == rows.where("x > 20").count()
    assert values["good", "rate"] == values["good", "conversions"] / values["good", "n"]
    assert values["good:poor", "difference"] == pytest.approx(values["good", "rate"] - values["poor", "rate"])
    assert values["good:poor", "significant"] == float(abs(values["good:poor", "z"]) > 1.96)


def test_a_batch_without_scores(spark, folder):
    store = scratch_path(spark, "unscored")
    nothing = {"a": lambda df: df.withColumn("score", F.lit(None).cast("double"))}
    Monitor("champion", nothing, store, "event_id", "ts").process(monitor_input(spark, folder), 0)
    assert all_metrics(spark, store, "champion").count() == 0


def test_restarts_continue_the_batches(spark, folder):
    stored = run_monitor(spark, folder, "multiarm")
    assert sorted({r.seq for r in stored.collect()}) == [0, 1, 2, 3]


def test_start_and_stop_with_a_period(spark, folder, tmp_path):
    rows = monitor_input(spark, folder)
    rows.select("event_id", "y", "x").coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    schema = rows.select("event_id", "y", "x").schema
    stream = csv_stream(spark, LoadSpec(str(tmp_path / "in"), True), schema).withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")
    )
    store = scratch_path(spark, "period")
    monitor = Monitor("abtesting", {"x": lambda df: df.withColumn("score", F.col("x"))}, store, "event_id", "ts")
    query = start(stream, monitor, scratch_path(spark, "period-check"), period_seconds=0.5)
    try:
        deadline = time.time() + 60
        while all_metrics(spark, store, "abtesting").isEmpty() and time.time() < deadline:
            time.sleep(0.5)
        assert query.isActive
    finally:
        stop(query)
    assert not query.isActive
    assert all_metrics(spark, store, "abtesting").where("metric = 'auc'").count() == 1


def test_sampling_a_static_table_every_period(spark, folder):
    store = scratch_path(spark, "sampled")
    monitor = Monitor("champion", scorers(), store, "event_id", "ts")
    query = start_sampling(monitor_input(spark, folder), monitor, 0.5, scratch_path(spark, "sampled-check"), 0.5)
    try:
        deadline = time.time() + 90
        while all_metrics(spark, store, "champion").agg(F.count_distinct("batch")).first()[0] < 2 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        stop(query)
    found = {r.batch: r.value for r in all_metrics(spark, store, "champion").where("metric = 'auc' and model = 'poor'").collect()}
    assert len(found) >= 2 and len(set(found.values())) == len(found)
