"""Small aggregates: rates, sums and summaries of metric series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbscore.functions import indicator


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows as a one-row table."""
    return df.agg(F.count("*").alias("linecount"))


def global_sum(df: DataFrame, column: str) -> DataFrame:
    """Sum of a column as a one-row table."""
    return df.agg(F.sum(column).alias("total"))


def indicator_rate(df: DataFrame, condition: Column, scale: float = 1.0) -> DataFrame:
    """``(hits, n, rate)`` with rate = scale * hits / n."""
    found = df.agg(F.sum(indicator(condition)).alias("hits"), F.count("*").alias("n"))
    return found.withColumn("rate", F.try_divide(F.lit(float(scale)) * F.col("hits"), F.col("n")))


def series_extent(df: DataFrame, time: str) -> DataFrame:
    """First and last time of a series."""
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def series_top(df: DataFrame, columns: Sequence[str], headroom: float = 1.1) -> DataFrame:
    """Largest value over all series, with headroom; nulls are skipped."""
    return df.agg((F.greatest(*[F.max(c) for c in columns]) * F.lit(headroom)).alias("top"))


def wide_metrics(df: DataFrame, time: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per time with one column per named series."""
    return df.groupBy(time).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))
