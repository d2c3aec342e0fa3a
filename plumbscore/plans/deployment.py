"""Deployed models over event-time windows: champions, drift, A/B tests and traffic splits.

All functions take and return DataFrames, so they serve a replay of a static table and the
stored results of a stream alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbscore.operators.clustering import nearest_centre, silhouette
from plumbscore.operators.curves import binary_counts, binary_summary, threshold_curve
from plumbscore.operators.running import ROWS_PER_SLICE, Running, running
from plumbscore.plans.training import score
from plumbscore.session import materialize

Z_95 = 1.959963984540054  # Fixed value: two-sided 95% point of the normal distribution.


def window_start(time: str, period: str) -> Column:
    """Start of the tumbling window that holds ``time``."""
    return F.window(time, period)["start"]


def window_counts(
    scored: DataFrame,
    time: str,
    period: str,
    score_column: str = "score",
    y: str = "y",
    keys: Sequence[str] = ("model",),
) -> DataFrame:
    """Positives and negatives per window, key and score. Counts of disjoint inputs add up."""
    return binary_counts(scored.withColumn("date", window_start(time, period)), score_column, y, ["date", *keys])


def window_metrics(
    scored: DataFrame,
    time: str,
    period: str,
    score_column: str = "score",
    y: str = "y",
    keys: Sequence[str] = ("model",),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Binary summary per window and key."""
    # These counts have one row per score: to sum them again would hold every score in three hash tables of a task.
    counts, by = window_counts(scored, time, period, score_column, y, keys), ["date", *keys]
    return binary_summary(threshold_curve(counts, by, rows_per_slice), by)


def metrics_of_counts(
    counts: DataFrame, keys: Sequence[str] = ("date", "model"), rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Binary summary of stored score counts, which may hold several rows per score."""
    summed = counts.groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return binary_summary(threshold_curve(summed, keys, rows_per_slice), keys)


def champion(metrics: DataFrame, time: str = "date", model: str = "model", value: str = "auc") -> DataFrame:
    """``(time, winner, winner_value, champion)`` per window.

    The winner has the highest value, the first name on a tie. The champion in force is the
    winner of the window before; the first window has none.
    """
    best = (
        metrics.where(F.col(value).isNotNull())
        .groupBy(time)
        .agg(F.min(F.struct((-F.col(value)).alias("negated"), F.col(model).alias("model"))).alias("best"))
        .select(time, F.col("best.model").alias("winner"), (-F.col("best.negated")).alias("winner_value"))
    )
    return running(best, time, [Running("champion", "winner", "last_before")])


def confirmed(metrics: DataFrame, pairs: DataFrame, time: str = "date", model: str = "model", value: str = "auc") -> DataFrame:
    """``(time, winner, runner_up, z, confirmed)`` per window: whether the best model leads the second by more than chance.

    ``pairs`` are the paired comparisons of the same windows. The first name wins a tie; a window with one model has no row.
    """
    order = F.struct((-F.col(value)).alias("negated"), F.col(model).alias("model"))
    # The two best of each window, by one partial aggregate: a window has a few models.
    best = metrics.where(F.col(value).isNotNull()).groupBy(time).agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("best"))
    two = best.where(F.size("best") == 2).select(time, F.col("best")[0].model.alias("winner"), F.col("best")[1].model.alias("runner_up"))
    named = pairs.withColumns({"__low": F.least("model_a", "model_b"), "__high": F.greatest("model_a", "model_b")})
    met = two.withColumns({"__low": F.least("winner", "runner_up"), "__high": F.greatest("winner", "runner_up")}).join(named, [time, "__low", "__high"])
    return met.select(time, "winner", "runner_up", F.abs("z").alias("z"), F.coalesce("significant", F.lit(False)).alias("confirmed"))


def place(
    df: DataFrame, features: Sequence[str | Column], clusters: PipelineModel | Sequence[Sequence[float]]
) -> DataFrame:
    """Add ``prediction``, the cluster of each row, by a fitted model or by given centres."""
    if isinstance(clusters, PipelineModel):
        return score(clusters, df, "prediction")
    return df.withColumn("prediction", nearest_centre(features, clusters))


def canary(
    df: DataFrame,
    time: str,
    period: str,
    features: Sequence[str | Column],
    clusters: PipelineModel | Sequence[Sequence[float]],
    baseline: float,
    tolerance: float = 0.1,
) -> DataFrame:
    """Silhouette of each window under trained clusters, and its drift from ``baseline``.

    ``drifted`` is true when the drift exceeds ``tolerance`` either way; null when a window
    fills fewer than two clusters.
    """
    placed = place(df, features, clusters).withColumn("date", window_start(time, period))
    measured = silhouette(placed, features, "prediction", ["date"])
    drift = F.col("silhouette") - F.lit(float(baseline))
    return measured.withColumn("drift", drift).withColumn("drifted", F.abs(drift) > F.lit(float(tolerance)))


def baseline_silhouette(
    df: DataFrame, features: Sequence[str | Column], clusters: PipelineModel | Sequence[Sequence[float]]
) -> float | None:
    """Silhouette of the training rows under their own clusters.

    The features and clusters are written once: they are read several times, and a filter on the cluster would otherwise
    derive the features again for every centre.
    """
    names = [f"__feature_{i}" for i in range(len(features))]
    columns = [(F.col(f) if isinstance(f, str) else f).cast("double").alias(name) for f, name in zip(features, names)]
    placed = materialize(place(df, features, clusters).select(*columns, "prediction"), "placed")
    return silhouette(placed, names, "prediction").first()["silhouette"]


def ab_rates(
    assigned: DataFrame, converted: Column, keys: Sequence[str] = ("date",), model: str = "model"
) -> DataFrame:
    """``n, conversions, rate`` per key and variant."""
    return (
        assigned.groupBy(*keys, model)
        .agg(F.count("*").alias("n"), F.count_if(converted).alias("conversions"))
        .withColumn("rate", F.try_divide(F.col("conversions"), F.col("n")))
    )


def ab_compare(rates: DataFrame, models: Sequence[str], keys: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Two-proportion z of every pair of the named variants, per key.

    The variants of a key are laid side by side by one aggregate, so no join is needed.
    """
    sides = []
    for position, name in enumerate(models):
        mine = F.col(model) == name
        sides.append(F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"__n{position}"))
        sides.append(F.coalesce(F.sum(F.when(mine, F.col("conversions"))), F.lit(0)).alias(f"__c{position}"))
    pairs = []
    for a, b in combinations(range(len(models)), 2):
        n_a, n_b, c_a, c_b = (F.col(f"__{kind}{i}") for kind, i in (("n", a), ("n", b), ("c", a), ("c", b)))
        pooled = F.try_divide(c_a + c_b, n_a + n_b)
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
        pairs.append(
            F.struct(
                F.lit(models[a]).alias("model_a"),
                F.lit(models[b]).alias("model_b"),
                (F.try_divide(c_a, n_a) - F.try_divide(c_b, n_b)).alias("difference"),
                F.try_divide(F.try_divide(c_a, n_a) - F.try_divide(c_b, n_b), spread).alias("z"),
            )
        )
    compared = rates.groupBy(*keys).agg(*sides).select(*keys, F.explode(F.array(*pairs)).alias("pair"))
    return compared.select(*keys, "pair.*").withColumn("significant", F.abs("z") > F.lit(Z_95))


MAX_MODELS = 1000


def hedge_splits(
    metrics: DataFrame, eta: float = 1.0, time: str = "date", model: str = "model", value: str = "auc"
) -> DataFrame:
    """Traffic shares ``split`` per window by exponential weights of all earlier values.

    The share is proportional to exp(eta * sum of earlier values), as in Hedge (Freund and
    Schapire, 1997); the first window shares equally. A model without a value in a window
    gains 0.5 there, as in the streaming monitor, and keeps its share. There are at most
    ``MAX_MODELS`` models. Values are summed as decimals, so a gain does not depend on how the windows were cut.
    """
    metrics = materialize(metrics.select(time, model, value), "hedged")
    names = sorted(r[0] for r in metrics.select(model).distinct().limit(MAX_MODELS + 1).collect() if r[0] is not None)
    if len(names) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    if names:
        listed = F.explode(F.array(*[F.lit(n) for n in names])).alias(model)
        known = metrics.groupBy(time, model).agg(F.max(value).alias(value))
        grid = known.select(time).distinct().select(time, listed)
        metrics = grid.join(known, [time, model], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.5)))
    exact = metrics.select(time, model, F.col(value).cast("decimal(28,18)").alias(value))
    summed = running(exact, time, [Running("gain", value, "sum_before")], keys=[model]).withColumn("gain", F.col("gain").cast("double"))
    window = Window.partitionBy(time)
    weighed = summed.withColumn("__w", F.exp(F.lit(float(eta)) * (F.col("gain") - F.max("gain").over(window))))
    return weighed.select(time, model, "gain", (F.col("__w") / F.sum("__w").over(window)).alias("split"))


def long_metrics(metrics: DataFrame, names: Sequence[str], time: str = "date", model: str = "model") -> DataFrame:
    """Metric columns to rows ``(date, model, metric, value)``."""
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return metrics.select(F.col(time).alias("date"), model, F.explode(F.array(*entries)).alias("entry")).select(
        "date", model, "entry.*"
    )


def metric_documents(metrics: DataFrame, models: Sequence[str], splits: bool = False) -> DataFrame:
    """One row per date: ``silhouette``, one AUC column per model and, if asked, ``<model>_split``."""
    names = {("kmeans", "silhouette"): "silhouette"}
    names.update({(m, "auc"): m for m in models})
    if splits:
        names.update({(m, "split"): f"{m}_split" for m in models})
    columns = [
        F.max(F.when((F.col("model") == m) & (F.col("metric") == k), F.col("value"))).alias(alias)
        for (m, k), alias in names.items()
    ]
    return metrics.groupBy("date").agg(*columns)
