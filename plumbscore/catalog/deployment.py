"""Deployed models over daily windows of the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.registered import (
    SHIFT_DOUBLES,
    SUMMARY_COLUMNS,
    SUMMARY_DOUBLES,
    hash_sql,
    query,
    rounded,
    shift_sql,
    summary_sql,
    table,
)
from plumbscore.operators.drift import input_shift, input_sketches
from plumbscore.operators.nearest import nearest
from plumbscore.operators.paired import compare_aucs
from plumbscore.operators.sampling import assign, window_sample
from plumbscore.plans.deployment import (
    ab_compare,
    ab_rates,
    baseline_silhouette,
    canary,
    champion,
    confirmed,
    hedge_splits,
    long_metrics,
    metric_documents,
    window_metrics,
    window_start,
)
from plumbscore.plans.experiments import ab_sequential, logged_gains, partial_splits, policy_values
from plumbscore.session import scratch_path
from plumbscore.sources.model_store import load_profile, profile_path, save_profile

MODELS = ["logisticRegression", "neuralNetwork", "randomForest"]
SCORED_SQL = """SELECT event_id, user_id, ts, date_trunc('day', ts) AS date, event_type, m.model,
    CASE m.model WHEN 'logisticRegression' THEN floor(value) / 512
      WHEN 'neuralNetwork' THEN (user_id % 64) / 64e0
      ELSE (event_id * 37 % 101) / 128e0 END AS score,
    CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS y
  FROM events, (VALUES ('logisticRegression'), ('neuralNetwork'), ('randomForest')) AS m(model)"""


def model_scores() -> dict[str, Column]:
    """Three stand-in models with exact scores."""
    return {
        "logisticRegression": F.floor("value") / 512,
        "neuralNetwork": F.pmod("user_id", F.lit(64)) / 64,
        "randomForest": F.pmod(F.col("event_id") * 37, F.lit(101)) / 128,
    }


def bought() -> Column:
    """1 for a purchase."""
    return F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event scored by every model, in long form."""
    entries = [F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in model_scores().items()]
    events = table(spark, folder, "events")
    return events.select(
        "event_id", "user_id", "ts", "event_type", bought().alias("y"), F.explode(F.array(*entries)).alias("e")
    ).select("event_id", "user_id", "ts", "event_type", "y", "e.model", "e.score")


DAILY_SQL = summary_sql(SCORED_SQL, ["date", "model"])


@query("window_auc", f"WITH {DAILY_SQL} SELECT date, model, {SUMMARY_COLUMNS} FROM s")
def window_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per day and model."""
    return rounded(window_metrics(scored_events(spark, folder), "ts", "1 day"), SUMMARY_DOUBLES)


SAMPLE_HASH = hash_sql("strftime(date, '%Y-%m-%d %H:%M:%S') || ':' || event_id", "window")


@query(
    "window_auc_sampled",
    f"""WITH {summary_sql(f"SELECT * FROM ({SCORED_SQL}) AS e WHERE {SAMPLE_HASH} < 0.5", ["date", "model"])}
        SELECT date, model, {SUMMARY_COLUMNS} FROM s""",
)
def window_auc_sampled(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per day and model on a fresh half of each day's events."""
    sampled = window_sample(scored_events(spark, folder), "event_id", "ts", "1 day", 0.5)
    return rounded(window_metrics(sampled, "ts", "1 day"), SUMMARY_DOUBLES)


@query(
    "champion",
    f"""WITH {DAILY_SQL},
        r AS (SELECT date, model, auc, row_number() OVER (PARTITION BY date ORDER BY auc DESC, model) AS place FROM s)
        SELECT date, model AS winner, round(auc, 6) AS winner_value, lag(model) OVER (ORDER BY date) AS champion
        FROM r WHERE place = 1""",
)
def champions(spark: SparkSession, folder: str) -> DataFrame:
    """Best model per day and the champion in force."""
    return rounded(champion(window_metrics(scored_events(spark, folder), "ts", "1 day")), ["winner_value"])


CENTRES = [[16.0, 16.0], [16.0, 80.0], [64.0, 48.0], [128.0, 16.0], [160.0, 80.0]]
POINTS_SQL = """SELECT event_id, date_trunc('day', ts) AS date, floor(value) AS x1,
    CAST(json_extract(props, '$.k') AS DOUBLE) AS x2 FROM events"""
CENTRES_SQL = "VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(CENTRES))


def pairwise_sql(points: str, key: str) -> str:
    """CTEs up to ``sil``: silhouette per key from all pairs of points."""
    return f"""
    pts AS ({points}),
    centres(c, c1, c2) AS ({CENTRES_SQL}),
    placed AS (SELECT event_id, {key}, x1, x2,
                 arg_min(c, ((x1 - c1) ** 2 + (x2 - c2) ** 2, c)) AS cluster FROM pts, centres GROUP BY ALL),
    sizes AS (SELECT {key}, cluster, count(*) AS n FROM placed GROUP BY ALL),
    dist AS (SELECT a.event_id, a.{key}, a.cluster AS mine, b.cluster AS other,
               sum((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS total
             FROM placed AS a JOIN placed AS b ON a.{key} = b.{key} GROUP BY ALL),
    ab AS (SELECT event_id, dist.{key}, max(n) FILTER (WHERE mine = other) AS own,
             max(total / nullif(n - 1, 0)) FILTER (WHERE mine = other) AS a,
             min(total / n) FILTER (WHERE mine <> other) AS b
           FROM dist JOIN sizes ON sizes.{key} = dist.{key} AND sizes.cluster = dist.other GROUP BY ALL),
    sil AS (SELECT {key}, count(*) AS rows,
              avg(CASE WHEN own = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette
            FROM ab GROUP BY {key})"""


@query(
    "canary",
    f"""WITH base AS (WITH {pairwise_sql(f"SELECT event_id, 1 AS one, x1, x2 FROM ({POINTS_SQL}) AS p "
                                          f"WHERE date < TIMESTAMP '2024-01-04'", "one")} SELECT silhouette FROM sil),
        {pairwise_sql(POINTS_SQL, "date")}
        SELECT sil.date, sil.rows, (SELECT count(*) FROM sizes WHERE sizes.date = sil.date) AS clusters,
          round(sil.silhouette, 6) AS silhouette, round(sil.silhouette - (SELECT silhouette FROM base), 6) AS drift,
          abs(sil.silhouette - (SELECT silhouette FROM base)) > 0.01 AS drifted FROM sil""",
)
def canaries(spark: SparkSession, folder: str) -> DataFrame:
    """Daily silhouette around fixed centres against that of the first three days."""
    points = table(spark, folder, "events").select(
        "ts",
        F.floor("value").cast("double").alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("x2"),
    )
    trained = points.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz"))
    baseline = baseline_silhouette(trained, ["x1", "x2"], CENTRES)
    found = canary(points, "ts", "1 day", ["x1", "x2"], CENTRES, baseline, 0.01)
    return rounded(found, ["silhouette", "drift"])


USER_HASH = hash_sql("CAST(event_id AS VARCHAR)", "traffic")
ASSIGNED_SQL = f"""SELECT event_id, date_trunc('day', ts) AS date, event_type, value, CASE
    WHEN {USER_HASH} < 0.5 THEN 'logisticRegression' WHEN {USER_HASH} < 0.75 THEN 'neuralNetwork'
    ELSE 'randomForest' END AS model FROM events"""
RATES_SQL = f"""SELECT date, model, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS conversions
    FROM ({ASSIGNED_SQL}) AS a GROUP BY 1, 2"""


def assigned_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events sent to one model each, 2 : 1 : 1."""
    events = table(spark, folder, "events").withColumn("date", window_start("ts", "1 day"))
    return assign(events, "event_id", MODELS, [2, 1, 1])


@query("ab_rates", f"SELECT date, model, n, conversions, round(conversions / n, 6) AS rate FROM ({RATES_SQL}) AS r")
def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Conversion rate per day and variant."""
    return rounded(ab_rates(assigned_events(spark, folder), F.col("event_type") == "purchase"), ["rate"])


@query(
    "ab_compare",
    f"""WITH r AS ({RATES_SQL}),
        p AS (SELECT a.date, a.model AS model_a, b.model AS model_b, a.conversions / a.n AS p1, b.conversions / b.n AS p2,
                (a.conversions + b.conversions) / (a.n + b.n) AS pooled, a.n AS n1, b.n AS n2
              FROM r AS a JOIN r AS b ON a.date = b.date AND a.model < b.model)
        SELECT date, model_a, model_b, round(p1 - p2, 6) AS difference,
          round((p1 - p2) / spread, 6) AS z, abs((p1 - p2) / spread) > 1.959963984540054 AS significant
        FROM (SELECT *, nullif(sqrt(pooled * (1 - pooled) * (1e0 / n1 + 1e0 / n2)), 0) AS spread FROM p) AS s""",
)
def compare(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of variants per day, with the z of their difference."""
    found = ab_rates(assigned_events(spark, folder), F.col("event_type") == "purchase")
    return rounded(ab_compare(found, MODELS, ["date"]), ["difference", "z"])


@query(
    "ab_metrics",
    f"""WITH {summary_sql(f'''SELECT s.date, s.model, s.score, s.y FROM ({SCORED_SQL}) AS s
          JOIN ({ASSIGNED_SQL}) AS a ON s.event_id = a.event_id AND s.model = a.model''', ["date", "model"])}
        SELECT date, model, {SUMMARY_COLUMNS} FROM s""",
)
def ab_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per day of each variant on its own traffic."""
    score = None
    for name, value in model_scores().items():
        hit = F.col("model") == name
        score = F.when(hit, value) if score is None else score.when(hit, value)
    scored = assigned_events(spark, folder).select("ts", "model", score.alias("score"), bought().alias("y"))
    return rounded(window_metrics(scored, "ts", "1 day"), SUMMARY_DOUBLES)


SPLITS_SQL = f"""{DAILY_SQL},
    gains AS (SELECT date, model, auc, coalesce(sum(auc) OVER (PARTITION BY model ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gain FROM s),
    splits AS (SELECT date, model, auc, gain, exp(4 * gain) / sum(exp(4 * gain)) OVER (PARTITION BY date) AS split
               FROM gains)"""


@query(
    "bandit_splits",
    f"WITH {SPLITS_SQL} SELECT date, model, round(gain, 6) AS gain, round(split, 6) AS split FROM splits",
)
def bandit_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic shares that follow the earlier AUC of each model."""
    daily = window_metrics(scored_events(spark, folder), "ts", "1 day")
    return rounded(hedge_splits(daily, eta=4.0), ["gain", "split"])


@query(
    "ab_sequential",
    f"""WITH r AS ({RATES_SQL}), d AS (SELECT DISTINCT date FROM r), m(model) AS (VALUES {", ".join(f"('{m}')" for m in MODELS)}),
        g AS (SELECT d.date, m.model, sum(coalesce(r.n, 0)) OVER w AS n, sum(coalesce(r.conversions, 0)) OVER w AS c
              FROM d CROSS JOIN m LEFT JOIN r ON r.date = d.date AND r.model = m.model
              WINDOW w AS (PARTITION BY m.model ORDER BY d.date)),
        p AS (SELECT a.date, a.model AS model_a, b.model AS model_b, a.n AS n_a, b.n AS n_b,
                a.c / nullif(a.n, 0) - b.c / nullif(b.n, 0) AS difference, (a.c + b.c) / nullif(a.n + b.n, 0) AS pooled
              FROM g AS a JOIN g AS b ON a.date = b.date AND a.model < b.model),
        v AS (SELECT *, nullif(pooled * (1 - pooled) * (1e0 / nullif(n_a, 0) + 1e0 / nullif(n_b, 0)), 0) AS v FROM p),
        l AS (SELECT *, ln(v / (v + 0.0004e0)) / 2 + 0.0004e0 * difference * difference / (2 * v * (v + 0.0004e0)) AS ratio FROM v),
        q AS (SELECT *, exp(-greatest(max(ratio) OVER (PARTITION BY model_a, model_b ORDER BY date), 0)) AS p FROM l),
        h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY date) + 1
                - row_number() OVER (PARTITION BY date ORDER BY p, model_a, model_b)) * p) AS step FROM q),
        k AS (SELECT *, max(step) OVER (PARTITION BY date ORDER BY p, model_a, model_b) AS adjusted FROM h)
        SELECT date, model_a, model_b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(difference, 6) AS difference,
          round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS significant FROM k""",
)
def sequential(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of variants on all traffic up to each day, with p-values for daily looks."""
    found = ab_rates(assigned_events(spark, folder), F.col("event_type") == "purchase")
    return rounded(ab_sequential(found, MODELS, tau=0.02), ["difference", "p", "adjusted"])


LOGGED_SQL = f"""WITH r AS ({RATES_SQL}), d AS (SELECT date, sum(n) AS rows_of_day FROM r GROUP BY 1),
    m(model, chance) AS (VALUES ('logisticRegression', 0.5e0), ('neuralNetwork', 0.25e0), ('randomForest', 0.25e0)),
    g AS (SELECT d.date, m.model, coalesce(r.n, 0) AS n, coalesce(r.conversions, 0) / chance AS paid, coalesce(r.n, 0) / chance AS weight,
            coalesce(r.conversions, 0) / chance / rows_of_day AS gain
          FROM d CROSS JOIN m LEFT JOIN r ON r.date = d.date AND r.model = m.model),
    t AS (SELECT *, coalesce(sum(gain) OVER (PARTITION BY model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM g),
    s AS (SELECT *, 0.9e0 * exp(4 * (total - max(total) OVER w)) / sum(exp(4 * (total - maximum))) OVER w + 0.1e0 / 3 AS split
          FROM (SELECT *, max(total) OVER (PARTITION BY date) AS maximum FROM t) WINDOW w AS (PARTITION BY date))"""


def logged_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Shares learnt from purchases under the model that each event was given to."""
    chances = F.create_map(*[F.lit(x) for pair in zip(MODELS, (0.5, 0.25, 0.25), strict=True) for x in pair])
    gains = logged_gains(assigned_events(spark, folder), MODELS, bought(), F.try_element_at(chances, F.col("model")))
    return partial_splits(gains, eta=4.0, mix=0.1)


@query(
    "bandit_partial",
    f"{LOGGED_SQL} SELECT date, model, CAST(n AS BIGINT) AS n, round(gain, 6) AS gain, round(split, 6) AS split FROM s",
)
def bandit_partial(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic shares that follow rewards seen only for the chosen model."""
    return rounded(logged_splits(spark, folder).select("date", "model", "n", "gain", "split"), ["gain", "split"])


@query(
    "bandit_policy_value",
    f"""{LOGGED_SQL} SELECT date, CAST(sum(n) AS BIGINT) AS n, round(avg(gain), 6) AS equal_value,
        round(sum(split * paid) / sum(n), 6) AS value, round(sum(split * paid) / sum(split * weight), 6) AS scaled_value FROM s GROUP BY date""",
)
def bandit_policy_value(spark: SparkSession, folder: str) -> DataFrame:
    """What these shares would have earned, by the log of fixed shares."""
    return rounded(policy_values(logged_splits(spark, folder)), ["equal_value", "value", "scaled_value"])


@query(
    "metric_documents",
    f"""WITH {SPLITS_SQL} SELECT date, CAST(NULL AS DOUBLE) AS silhouette,
        {", ".join(f'round(max(auc) FILTER (WHERE model = {m!r}), 6) AS "{m}"' for m in MODELS)},
        {", ".join(f'round(max(split) FILTER (WHERE model = {m!r}), 6) AS "{m}_split"' for m in MODELS)}
        FROM splits GROUP BY date""",
)
def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per day with the AUC and the traffic share of each model."""
    daily = window_metrics(scored_events(spark, folder), "ts", "1 day")
    both = long_metrics(daily, ["auc"]).unionByName(long_metrics(hedge_splits(daily, eta=4.0), ["split"]))
    return rounded(metric_documents(both, MODELS, splits=True), [*MODELS, *[f"{m}_split" for m in MODELS]])


def _nearest_sql(by: str) -> str:
    key = "user_id" if by else "1"
    return f"""WITH series AS (SELECT {key} AS k, ts, min(value) AS value FROM events WHERE event_type = 'purchase'
                 GROUP BY ALL),
      probes AS (SELECT event_id, {key} AS k, ts FROM events WHERE event_type <> 'purchase'),
      b AS (SELECT p.event_id, p.ts, s.ts AS at, s.value FROM probes AS p ASOF LEFT JOIN series AS s
            ON p.k = s.k AND p.ts >= s.ts),
      a AS (SELECT p.event_id, s.ts AS at, s.value FROM probes AS p ASOF LEFT JOIN series AS s
            ON p.k = s.k AND p.ts <= s.ts),
      j AS (SELECT b.event_id, b.ts, b.at AS b_at, b.value AS b_value, a.at AS a_at, a.value AS a_value,
              b.at IS NULL OR coalesce(epoch_us(a.at) - epoch_us(b.ts) < epoch_us(b.ts) - epoch_us(b.at), FALSE) AS later
            FROM b JOIN a USING (event_id))
      SELECT event_id, ts, CASE WHEN later THEN a_at ELSE b_at END AS nearest_time,
        CASE WHEN later THEN a_value ELSE b_value END AS nearest_value FROM j"""


def _probes_and_series(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events")
    series = events.where(F.col("event_type") == "purchase").select("user_id", "ts", "value")
    return events.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts"), series


@query("nearest_metric", _nearest_sql(""))
def nearest_metric(spark: SparkSession, folder: str) -> DataFrame:
    """The purchase closest in time to every other event."""
    probes, series = _probes_and_series(spark, folder)
    return nearest(probes.drop("user_id"), series, "ts", "value", rows_per_slice=2_000)


@query("nearest_metric_by_user", _nearest_sql("user_id"))
def nearest_metric_by_user(spark: SparkSession, folder: str) -> DataFrame:
    """The same among the events of each user."""
    probes, series = _probes_and_series(spark, folder)
    return nearest(probes, series, "ts", "value", by=["user_id"]).drop("user_id")


SMALL_K = 65535  # Sketches of the test tables of the smaller sizes are exact, so SQL can tell the same distances.
INPUTS = ["x1", "x2", "x3"]
INPUTS_SQL = """SELECT ts, unnest(['x1', 'x2', 'x3']) AS feature, unnest([floor(value), CAST(props->>'$.k' AS DOUBLE),
    CASE WHEN user_id % 7 <> 0 THEN (event_id % 1000) / 10e0 END]) AS x FROM events"""


def model_inputs(events: DataFrame) -> DataFrame:
    """``events`` with three features: one with few values, one from JSON, and one with gaps that grows with time."""
    return events.withColumns(
        {
            "x1": F.floor("value").cast("double"),
            "x2": F.get_json_object("props", "$.k").cast("double"),
            "x3": F.when(F.col("user_id") % 7 != 0, (F.col("event_id") % 1000) / 10),
        }
    )


@query(
    "input_shift",
    f"""WITH {shift_sql(f"SELECT feature, x FROM ({INPUTS_SQL}) AS i WHERE ts < TIMESTAMP '2024-01-04'",
                        f"SELECT date_trunc('day', ts) AS date, feature, x FROM ({INPUTS_SQL}) AS i", ["date"])}
        SELECT date, feature, n_base, n, {", ".join(f"round({c}, 6) AS {c}" for c in SHIFT_DOUBLES)}, shifted FROM shift""",
)
def input_shift_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of each day against those of the first three days, whose sketches are stored and read again."""
    rows = model_inputs(table(spark, folder, "events"))
    path = profile_path(scratch_path(spark, "models"), "kmeans")
    save_profile(input_sketches(rows.where("ts < timestamp_ntz'2024-01-04'"), INPUTS, k=SMALL_K), path)
    days = input_sketches(rows.withColumn("date", window_start("ts", "1 day")), INPUTS, ["date"], SMALL_K)
    return rounded(input_shift(load_profile(spark, path), days, ["date"]), SHIFT_DOUBLES)


PAIRED_SQL = f"""e AS ({SCORED_SQL}),
    placed AS (SELECT a.date, a.model, a.event_id, a.y, avg(CASE WHEN a.score = b.score THEN 0.5e0
                 WHEN (a.score > b.score) = (a.y > 0.5) THEN 1e0 ELSE 0e0 END) AS v
               FROM e AS a JOIN e AS b ON a.date = b.date AND a.model = b.model AND (a.y > 0.5) <> (b.y > 0.5) GROUP BY 1, 2, 3, 4),
    apart AS (SELECT a.date, a.model AS model_a, b.model AS model_b, a.y > 0.5 AS positive, a.v - b.v AS d
              FROM placed AS a JOIN placed AS b USING (date, event_id) WHERE a.model < b.model),
    paired AS (SELECT date, model_a, model_b, count(*) AS rows, avg(d) FILTER (positive) AS difference,
                 sqrt(var_samp(d) FILTER (positive) / count(*) FILTER (positive)
                   + var_samp(d) FILTER (NOT positive) / count(*) FILTER (NOT positive)) AS error
               FROM apart GROUP BY 1, 2, 3)"""


@query(
    "champion_paired_test",
    f"""WITH {PAIRED_SQL} SELECT date, model_a, model_b, rows, round(difference, 6) AS difference, round(difference / error, 6) AS z,
          abs(difference / error) > 1.959963984540054 AS significant FROM paired""",
)
def champion_paired_test(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the models of a day differ by more than chance on the same events, for every pair."""
    scored = scored_events(spark, folder).withColumn("date", window_start("ts", "1 day"))
    return rounded(compare_aucs(scored, "event_id", MODELS, ["date"]), ["difference", "z"])


@query(
    "champion_confirmed",
    f"""WITH {PAIRED_SQL}, r AS (WITH {DAILY_SQL} SELECT date, model, row_number() OVER (PARTITION BY date ORDER BY auc DESC, model) AS place FROM s),
        ranked AS (SELECT a.date, a.model AS winner, b.model AS runner_up FROM r AS a JOIN r AS b ON a.date = b.date AND a.place = 1 AND b.place = 2)
        SELECT date, winner, runner_up, round(abs(difference / error), 6) AS z, abs(difference / error) > 1.959963984540054 AS confirmed
        FROM ranked JOIN paired USING (date) WHERE (winner = model_a AND runner_up = model_b) OR (winner = model_b AND runner_up = model_a)""",
)
def champion_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    """The winner of each day, the second best, and whether the lead is more than chance."""
    scored = scored_events(spark, folder).withColumn("date", window_start("ts", "1 day"))
    metrics = window_metrics(scored.drop("date"), "ts", "1 day")
    return rounded(confirmed(metrics, compare_aucs(scored, "event_id", MODELS, ["date"])), ["z"])
