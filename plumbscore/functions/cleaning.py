"""Null handling, indicators and tolerant casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_numbers(df: DataFrame, columns: Sequence[str] | None = None, value: float = 0) -> DataFrame:
    """Replace null and NaN by ``value`` in numeric columns (all of them, or those named)."""
    return df.na.fill(value, subset=list(columns) if columns is not None else None)


def indicator(condition: Column) -> Column:
    """1 where the condition holds, otherwise 0, also where it is null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def parse_number(column: str) -> Column:
    """Text to double; null where the text is no number."""
    return F.col(column).cast("string").try_cast("double")


def parse_time(column: str) -> Column:
    """Text to a timestamp without zone; null where the text is no time."""
    return F.col(column).cast("string").try_cast("timestamp_ntz")
