"""Weighted traffic assignment and per-period samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbscore.functions import hash_uniform, pick_by_weight

CLUSTERING_MODELS = ("kmeans",)


def traffic_models(models: Sequence[str]) -> list[str]:
    """The models that can take traffic: clustering models have no score to compare."""
    return [m for m in models if m not in CLUSTERING_MODELS]


def equal_weights(models: Sequence[str]) -> list[float]:
    """Starting weights, rounded to two digits; they need not sum to one."""
    return [round(1.0 / len(models), 2) for _ in models]


def assign(
    df: DataFrame,
    key: str | Sequence[str],
    models: Sequence[str],
    weights: Sequence[float | str],
    salt: str = "traffic",
    output: str = "model",
) -> DataFrame:
    """Send each key to one model, with chances proportional to the weights."""
    keys = [key] if isinstance(key, str) else list(key)
    # A column of its own: every bound is compared with it, and the hash is taken once a row.
    hashed = df.withColumn("__uniform", hash_uniform(*keys, salt=salt))
    return hashed.withColumn(output, pick_by_weight(F.col("__uniform"), models, weights)).drop("__uniform")


def period_sample(df: DataFrame, key: str, period: int, fraction: float) -> DataFrame:
    """The sample of one period; every period draws afresh and repeatably."""
    return df.where(hash_uniform(key, salt=f"period-{period}") < F.lit(float(fraction)))


def window_sample(df: DataFrame, key: str, time: str, period: str, fraction: float) -> DataFrame:
    """A replayed stream: in every tumbling window a fresh sample of the rows."""
    start = F.window(time, period)["start"].cast("string")
    uniform = hash_uniform("__window", key, salt="window")
    return df.withColumn("__window", start).where(uniform < F.lit(float(fraction))).drop("__window")


def random_sample(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    """Spark's own sample."""
    return df.sample(fraction=fraction, seed=seed)
