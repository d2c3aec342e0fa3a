"""Nearest-in-time lookup of a value in a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbscore.operators.joins import join_same
from plumbscore.operators.running import ROWS_PER_SLICE, Running, running


def nearest(
    probes: DataFrame,
    series: DataFrame,
    time: str,
    value: str,
    by: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``probes`` plus ``nearest_time`` and ``nearest_value`` of the closest series point.

    Both tables carry ``time`` and the ``by`` columns. The later neighbour wins only when it
    is strictly closer. Several series points at one time count as their smallest value.

    Probes are first reduced to distinct times, so many probes at one instant cost one row
    in the ordered part; the join back is on that instant, where adaptive execution splits
    a hot one.
    """
    point = F.struct(F.col(time).alias("at"), F.col(value).alias("value"))
    known = series.where(F.col(value).isNotNull()).groupBy(*by, time).agg(F.min(point).alias("__point"))
    asked = probes.select(*by, time).distinct()
    times = (
        known.unionByName(asked, allowMissingColumns=True)
        .where(F.col(time).isNotNull())
        .groupBy(*by, time)
        .agg(F.max("__point").alias("__point"))
    )
    placed = running(
        times,
        order=time,
        values=[Running("__before", "__point", "last"), Running("__after", "__point", "next")],
        keys=by,
        rows_per_slice=rows_per_slice,
    )
    gap_before = F.col(time) - F.col("__before.at")
    gap_after = F.col("__after.at") - F.col(time)
    closer = F.when(F.col("__before").isNull() | (gap_after < gap_before), F.col("__after")).otherwise(F.col("__before"))
    answers = placed.select(
        *by, time, closer["at"].alias("nearest_time"), closer["value"].alias("nearest_value")
    )
    return join_same(probes, answers, [*by, time], "left")
