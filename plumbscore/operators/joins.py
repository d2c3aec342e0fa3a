"""Equality joins that match null keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbscore.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024
# Rows in memory may take this many times the bytes of the parquet files they were written to.
EXPANSION = 8
MAX_HOT = 1000
SLICE_ROWS = 10_000


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, where all ``keys`` agree, null with null."""
    extra = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias("__right_" + k) for k in keys], *extra)
    same = None
    for key in keys:
        match = left[key].eqNullSafe(renamed["__right_" + key])
        same = match if same is None else same & match
    return left.join(renamed, same, how).select(*[left[c] for c in left.columns], *[renamed[c] for c in extra])


def join_dealt(left: DataFrame, right: DataFrame, counts: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Inner :func:`join_same` where a few ``keys`` may hold most rows of ``left``.

    ``counts`` has the number of rows of ``left`` per key in ``count``. Keys with more than ``SLICE_ROWS`` rows and more
    than one in ``MAX_HOT`` of all are dealt to slices by a hash of the column ``by`` of ``left``, and their rows of ``right`` are
    repeated once a slice. There are fewer than ``MAX_HOT`` such keys, so the table that marks them goes to every task.
    """
    most = max(SLICE_ROWS, (counts.agg(F.sum("count")).first()[0] or 0) / MAX_HOT)
    slices = F.ceil(F.col("count") / F.lit(float(most))).cast("int")
    hot = F.broadcast(materialize(counts.where(F.col("count") > most).select(*keys, slices.alias("__slices")), "hot-keys"))
    number = F.pmod(F.xxhash64(by), F.coalesce("__slices", F.lit(1))).cast("int")
    dealt = join_same(left, hot, keys, "left").withColumn("__slice", number).drop("__slices")
    last = F.coalesce(F.col("__slices"), F.lit(1)) - 1
    repeated = join_same(right, hot, keys, "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), last))).drop("__slices")
    return join_same(dealt, repeated, [*keys, "__slice"]).drop("__slice")


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """Write ``df`` out, measure it, and mark it for broadcast only if it fits.

    It counts as the larger of ``bytes_per_row`` for every row and ``EXPANSION`` times the written
    bytes, so wide keys and long texts count as well. Beyond ``BROADCAST_BYTES`` the join goes by shuffle, with the same result.
    """
    written = materialize(df, "side")
    stored = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = max(written.count() * bytes_per_row, EXPANSION * int(str(stored)))
    return F.broadcast(written) if size <= BROADCAST_BYTES else written
