"""Streaming jobs run to the end of the event table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.deployment import CENTRES, INPUTS, INPUTS_SQL, POINTS_SQL, SCORED_SQL, SMALL_K, bought, model_inputs, model_scores, pairwise_sql, scored_events
from plumbscore.catalog.registered import (
    SUMMARY_COLUMNS,
    SUMMARY_DOUBLES,
    hash_sql,
    query,
    rounded,
    shift_sql,
    summary_sql,
    table,
)
from plumbscore.operators.drift import input_sketches
from plumbscore.plans.deployment import baseline_silhouette, metrics_of_counts
from plumbscore.session import scratch_path
from plumbscore.sources.metric_store import all_metrics
from plumbscore.streaming.monitor import Monitor, start
from plumbscore.streaming.streams import event_time, parquet_stream, score_counts, start_counts
from plumbscore.streaming.windows import WindowStore, start_windows

CHUNK_STARTS = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]


@query(
    "stream_window_auc",
    f"""WITH {summary_sql(f'''SELECT * FROM ({SCORED_SQL}) AS s WHERE date + INTERVAL 1 DAY <=
          (SELECT max(ts) - INTERVAL 1 HOUR FROM events)''', ["date", "model"])}
        SELECT date, model, {SUMMARY_COLUMNS} FROM s""",
)
def stream_window_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the closed daily windows, from streamed score counts."""
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")
    schema = table(spark, folder, "events").schema
    # Written as a pattern, the path may be one file or a folder of files.
    stream = event_time(parquet_stream(spark, os.path.join(folder, "{events}.parquet"), schema), "ts")
    entries = [F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in model_scores().items()]
    scored = stream.select("ts", bought().alias("y"), F.explode(F.array(*entries)).alias("e")).select("ts", "y", "e.*")
    counts = score_counts(scored, "ts", "1 day", "1 hour")
    start_counts(counts, path, checkpoint).awaitTermination()
    stored = spark.read.schema(counts.schema).parquet(path).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return rounded(metrics_of_counts(stored), SUMMARY_DOUBLES)


def run_monitor(spark: SparkSession, folder: str, mode: str, inputs: bool = False) -> DataFrame:
    """Feed the events to a monitor in four parts, restarting it for each, and return its metrics."""
    source, store, checkpoint = (scratch_path(spark, name) for name in ("source", "store", "checkpoint"))
    events = table(spark, folder, "events")
    scorers = {
        name: (lambda df, value=value: df.withColumn("score", value)) for name, value in model_scores().items()
    }
    features = {"x1": F.floor("value").cast("double"), "x2": F.get_json_object("props", "$.k").cast("double")}
    trained = events.where("ts < timestamp_ntz'2024-01-04'").withColumns(features)
    monitor = Monitor(
        mode,
        scorers,
        store,
        "event_id",
        "ts",
        eta=4.0,
        canary=CENTRES,
        canary_features=list(features),
        baseline=baseline_silhouette(trained, list(features), CENTRES),
        tolerance=0.01,
        converted="event_type = 'purchase'",
        inputs=input_sketches(model_inputs(trained), INPUTS, k=SMALL_K).cache() if inputs else None,
    )
    for begin, end in zip(CHUNK_STARTS, [*CHUNK_STARTS[1:], "9999-01-01"]):
        chunk = events.where(f"ts >= timestamp_ntz'{begin}' AND ts < timestamp_ntz'{end}'")
        chunk.write.mode("append").parquet(source)
        stream = parquet_stream(spark, source, events.schema, files_per_trigger=None)
        rows = stream.withColumns({"y": bought(), **features})
        start(model_inputs(rows) if inputs else rows, monitor, checkpoint).awaitTermination()
    return all_metrics(spark, store, mode)


CHUNK_SQL = "CASE " + " ".join(
    f"WHEN ts < TIMESTAMP '{end}' THEN {i}" for i, end in enumerate(CHUNK_STARTS[1:])
) + f" ELSE {len(CHUNK_STARTS) - 1} END"


@query(
    "stream_champion",
    f"""WITH {summary_sql(f"SELECT {CHUNK_SQL} AS seq, model, score, y FROM ({SCORED_SQL}) AS e", ["seq", "model"])},
        r AS (SELECT seq, model, auc, row_number() OVER (PARTITION BY seq ORDER BY auc DESC, model) AS place FROM s)
        SELECT CAST(seq AS BIGINT) AS seq, model, 'auc' AS metric, round(auc, 6) AS value FROM r
        UNION ALL SELECT seq, model, 'winner', round(auc, 6) FROM r WHERE place = 1
        UNION ALL SELECT seq + 1, model, 'champion', round(auc, 6) FROM r
          WHERE place = 1 AND seq < (SELECT max(seq) FROM r)""",
)
def stream_champion(spark: SparkSession, folder: str) -> DataFrame:
    """A champion monitor over four batches."""
    return _monitored(spark, folder, "champion")


MODELS = ["logisticRegression", "neuralNetwork", "randomForest"]
EQUAL_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', 1e0 / 3)" for m in MODELS) + ") AS v(model, split)"


def _routed_sql(seq: int, mode: str, splits: str, tag: str) -> str:
    """CTEs up to ``auc_<tag>``: events of one batch sent to models by the shares in ``splits``."""
    event_hash = hash_sql("CAST(event_id AS VARCHAR)", f"{mode}-{seq}")
    return f"""
    upper_{tag} AS (SELECT model, coalesce(sum(split) OVER (ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0) AS low, sum(split) OVER (ORDER BY model) AS high FROM ({splits}) AS p),
    sent_{tag} AS (SELECT e.model, e.score, e.y FROM ({SCORED_SQL}) AS e JOIN upper_{tag} AS u
             ON e.model = u.model AND {event_hash} >= u.low AND {event_hash} < u.high
             WHERE {CHUNK_SQL} = {seq}),
    auc_{tag} AS (WITH {summary_sql(f"SELECT * FROM sent_{tag}", ["model"])} SELECT model, auc FROM s)"""


def _bandit_sql() -> str:
    """Four batches, each routed by the shares that the earlier ones led to."""
    steps = ["gain_0 AS (SELECT model, 0e0 AS gain FROM (" + EQUAL_SQL + ") AS v)"]
    for seq in range(len(CHUNK_STARTS)):
        steps.append(
            f"""share_{seq} AS (SELECT model, gain, 0.9e0 * exp(4 * gain) / (SELECT sum(exp(4 * gain)) FROM gain_{seq})
                  + 0.1e0 / 3 AS split FROM gain_{seq})"""
        )
        steps.append(_routed_sql(seq, "multiarm", f"SELECT * FROM share_{seq}", f"b{seq}"))
        steps.append(
            f"""gain_{seq + 1} AS (SELECT model, gain + coalesce(auc, 0.5) AS gain
                  FROM gain_{seq} LEFT JOIN auc_b{seq} USING (model))"""
        )
    rows = " UNION ALL ".join(
        f"""SELECT CAST({seq} AS BIGINT) AS seq, model, 'auc' AS metric, round(auc, 6) AS value FROM auc_b{seq}
        UNION ALL SELECT {seq}, model, 'split', round(split, 6) FROM share_{seq}
        UNION ALL SELECT {seq}, model, 'gain', round(gain, 6) FROM gain_{seq + 1}"""
        for seq in range(len(CHUNK_STARTS))
    )
    return f"WITH {', '.join(steps)} {rows}"


def _abtest_sql() -> str:
    """Four batches, each routed by equal shares."""
    batches = range(len(CHUNK_STARTS))
    steps = ", ".join(_routed_sql(seq, "abtesting", EQUAL_SQL, f"b{seq}") for seq in batches)
    steps += "".join(
        f""", rate_b{seq} AS (SELECT model, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS c FROM sent_b{seq} GROUP BY 1),
        pair_b{seq} AS (SELECT a.model || ':' || b.model AS model, a.c / a.n - b.c / b.n AS difference,
            (a.c / a.n - b.c / b.n) / nullif(sqrt((a.c + b.c) / (a.n + b.n) * (1 - (a.c + b.c) / (a.n + b.n))
              * (1 / a.n + 1 / b.n)), 0) AS z
          FROM rate_b{seq} AS a JOIN rate_b{seq} AS b ON a.model < b.model)"""
        for seq in batches
    )
    rows = " UNION ALL ".join(
        f"""SELECT CAST({seq} AS BIGINT) AS seq, model, 'auc' AS metric, round(auc, 6) AS value FROM auc_b{seq}
        UNION ALL SELECT {seq}, model, 'split', round(split, 6) FROM ({EQUAL_SQL}) AS v
        UNION ALL SELECT {seq}, model, unnest(['n', 'conversions', 'rate']), unnest([n, c, round(c / n, 6)]) FROM rate_b{seq}
        UNION ALL SELECT {seq}, model, 'difference', round(difference, 6) FROM pair_b{seq}
        UNION ALL SELECT {seq}, model, 'z', round(z, 6) FROM pair_b{seq} WHERE z IS NOT NULL
        UNION ALL SELECT {seq}, model, 'significant', CASE WHEN abs(z) > 1.959963984540054 THEN 1 ELSE 0 END
          FROM pair_b{seq} WHERE z IS NOT NULL"""
        for seq in batches
    )
    return f"WITH {steps} {rows}"


def _monitored(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    """The metrics of the models that take traffic."""
    stored = run_monitor(spark, folder, mode).where(F.col("model") != "kmeans")
    return rounded(stored.select("seq", "model", "metric", "value"), ["value"])


@query("stream_bandit", _bandit_sql())
def stream_bandit(spark: SparkSession, folder: str) -> DataFrame:
    """A bandit monitor over four batches, each routed by what the earlier ones measured."""
    return _monitored(spark, folder, "multiarm")


@query("stream_abtest", _abtest_sql())
def stream_abtest(spark: SparkSession, folder: str) -> DataFrame:
    """An A/B monitor over four batches, with rates and the comparison of every pair."""
    return _monitored(spark, folder, "abtesting")


@query(
    "stream_canary",
    f"""WITH base AS (WITH {pairwise_sql(f"SELECT event_id, 1 AS one, x1, x2 FROM ({POINTS_SQL}) AS p "
                                         f"WHERE date < TIMESTAMP '2024-01-04'", "one")} SELECT silhouette FROM sil),
        {pairwise_sql(f"SELECT event_id, {CHUNK_SQL.replace('ts <', 'date <')} AS seq, x1, x2 FROM ({POINTS_SQL}) AS p", "seq")},
        found AS (SELECT CAST(seq AS BIGINT) AS seq, silhouette, silhouette - (SELECT silhouette FROM base) AS drift FROM sil)
        SELECT seq, 'kmeans' AS model, unnest(['silhouette', 'drift', 'drifted']) AS metric,
          unnest([round(silhouette, 6), round(drift, 6), CASE WHEN abs(drift) > 0.01 THEN 1 ELSE 0 END]) AS value FROM found""",
)
def stream_canary(spark: SparkSession, folder: str) -> DataFrame:
    """The silhouette of four streamed batches, its drift from the first three days, and the flag."""
    stored = run_monitor(spark, folder, "champion").where(F.col("model") == "kmeans")
    return rounded(stored.select("seq", "model", "metric", "value"), ["value"])


@query(
    "stream_input_shift",
    f"""WITH {shift_sql(f"SELECT feature, x FROM ({INPUTS_SQL}) AS i WHERE ts < TIMESTAMP '2024-01-04'",
                        f"SELECT CAST({CHUNK_SQL} AS BIGINT) AS seq, feature, x FROM ({INPUTS_SQL}) AS i", ["seq"])}
        SELECT seq, 'input:' || feature AS model, unnest(['ks', 'psi', 'shifted']) AS metric,
          unnest([round(ks, 6), round(psi, 6), CASE WHEN shifted THEN 1e0 ELSE 0e0 END]) AS value FROM shift""",
)
def stream_input_shift(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of four streamed batches against those of the first three days."""
    stored = run_monitor(spark, folder, "champion", inputs=True).where(F.col("model").startswith("input:"))
    return rounded(stored.select("seq", "model", "metric", "value"), ["value"])


ARRIVAL_SQL = f"{CHUNK_SQL} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END"
LATE_SQL = f"""placed AS (SELECT *, {ARRIVAL_SQL} AS batch FROM ({SCORED_SQL}) AS e),
    highs AS (SELECT batch, max(ts) AS high FROM placed GROUP BY batch),
    befores AS (SELECT a.batch, max(b.high) AS high FROM highs AS a LEFT JOIN highs AS b ON b.batch < a.batch GROUP BY a.batch),
    judged AS (SELECT date, model, score, y, coalesce(date + INTERVAL 1 DAY <= high - INTERVAL 1 HOUR, false) AS is_late
               FROM placed JOIN befores USING (batch))"""


@query(
    "stream_all_windows",
    f"""WITH {LATE_SQL}, summary AS (WITH {summary_sql("SELECT * FROM judged WHERE NOT is_late", ["date", "model"])} SELECT * FROM s),
        late AS (SELECT date, model, count(*) AS late FROM judged WHERE is_late GROUP BY 1, 2)
        SELECT date, model, {SUMMARY_COLUMNS}, coalesce(late, 0) AS late,
          date + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS is_open
        FROM summary FULL JOIN late USING (date, model)""",
)
def stream_all_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of all daily windows, open ones too, from events of which every tenth comes a batch late.

    Batches are summed twice on the way, and one is replayed.
    """
    source, path, checkpoint = (scratch_path(spark, name) for name in ("source", "windows", "checkpoint"))
    events = table(spark, folder, "events")
    entries = [F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in model_scores().items()]
    store = WindowStore(path, "ts", "1 day", "1 hour")
    for batch in range(len(CHUNK_STARTS) + 1):
        arrived = events.where(F.expr(ARRIVAL_SQL.replace("TIMESTAMP", "timestamp_ntz")) == batch)
        arrived.write.mode("append").parquet(source)
        rows = parquet_stream(spark, source, events.schema, files_per_trigger=None)
        scored = rows.select("ts", bought().alias("y"), F.explode(F.array(*entries)).alias("e")).select("ts", "y", "e.*")
        start_windows(scored, store, checkpoint).awaitTermination()
        if batch in (2, 3):
            store.compact(spark, batch)
    store.process(scored_events(spark, folder).where(F.expr(ARRIVAL_SQL.replace("TIMESTAMP", "timestamp_ntz")) == batch), batch)
    return rounded(store.metrics(spark).withColumn("date", F.col("date").cast("timestamp_ntz")), SUMMARY_DOUBLES)
