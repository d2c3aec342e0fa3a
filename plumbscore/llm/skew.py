"""Joins of rows with one row per key, where one key may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT = 1000
ROWS_PER_SLICE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, how: str = "inner", least: int = ROWS_PER_SLICE) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key and in ``count`` the rows of ``left`` with it.

    Keys with more than ``least`` rows and more than one in ``MAX_HOT`` of all rows are hot. There are
    fewer than ``MAX_HOT`` of them, so the table that marks them goes to every task. Their rows on the left
    are dealt to slices by a hash, so that a slice has about as many rows as the least hot key, and their row on the right is
    repeated once a slice. Rows with a null key meet nothing. ``right`` is read three times, so it should be a written table.
    """
    most = max(least, (right.agg(F.sum(count)).first()[0] or 0) / MAX_HOT)
    slices = F.ceil(F.col(count) / F.lit(float(most))).cast("int")
    hot = right.where(F.col(count) > most).select(*keys, slices.alias("__slices"))
    dealt = left.join(F.broadcast(hot), list(keys), "left")
    dealt = dealt.withColumn("__slice", F.pmod(F.xxhash64(*left.columns), F.coalesce("__slices", F.lit(1))).cast("int")).drop("__slices")
    last = F.when(F.col(count) > most, slices - 1).otherwise(0)
    repeated = right.withColumn("__slice", F.explode(F.sequence(F.lit(0), last))).drop(count)
    return dealt.join(repeated, [*keys, "__slice"], how).drop("__slice")
