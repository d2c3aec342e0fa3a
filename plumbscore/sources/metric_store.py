"""Metric series as parquet tables, one per deployment mode.

New batches are in ``recent``, one folder per ``batch``. Writing a batch replaces that batch
only, so a replayed micro-batch cannot add its rows twice. :func:`compact_metrics` moves them
into ``closed``, one folder for ``SPAN`` batches, so the files of a monitor that runs for months
stay few. A batch that is in both counts as in ``recent``: it was replayed, or a compaction
was interrupted.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.session import delete_folder, materialize

# The names of the deployment modes.
MODES = ("champion", "abtesting", "multiarm")
METRIC_SCHEMA = "seq bigint, date timestamp_ntz, model string, metric string, value double, batch bigint"
METRIC_COLUMNS = ["seq", "date", "model", "metric", "value", "batch"]
SPAN = 500


def _folder(root: str, mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    return os.path.join(root, mode)


def append_metrics(metrics: DataFrame, root: str, mode: str, batch: int | None = None) -> None:
    """Store ``(seq, date, model, metric, value)`` rows under a batch number.

    ``batch`` defaults to a column of that name. Rebalancing keeps the files few, and adaptive
    execution splits a batch that is too large for one task.
    """
    numbered = metrics.withColumn("batch", F.lit(batch).cast("bigint")) if batch is not None else metrics
    (
        numbered.select(
            F.col("seq").cast("bigint"),
            F.col("date").cast("timestamp_ntz"),
            "model",
            "metric",
            F.col("value").cast("double"),
            F.col("batch").cast("bigint"),
        )
        .hint("rebalance", "batch")
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("batch")
        .parquet(os.path.join(_folder(root, mode), "recent"))
    )


def _read(spark: SparkSession, folder: str, *path: str) -> DataFrame:
    try:
        found = spark.read.schema(METRIC_SCHEMA).option("basePath", folder).parquet(os.path.join(folder, *path))
        return found.select(*METRIC_COLUMNS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], METRIC_SCHEMA)


def all_metrics(spark: SparkSession, root: str, mode: str) -> DataFrame:
    """The whole series of a mode; empty when nothing was stored."""
    folder = _folder(root, mode)
    recent, closed = _read(spark, os.path.join(folder, "recent")), _read(spark, os.path.join(folder, "closed"))
    older = closed.join(recent.select("batch").distinct(), "batch", "left_anti")
    return recent.unionAll(older.select(*METRIC_COLUMNS))


def batch_metrics(spark: SparkSession, root: str, mode: str, batch: int) -> DataFrame:
    """The metrics of one recent batch, read from its own folder without listing the others."""
    return _read(spark, os.path.join(_folder(root, mode), "recent"), f"batch={batch}")


def compact_metrics(spark: SparkSession, root: str, mode: str, before: int) -> None:
    """Close the whole spans of ``SPAN`` batches below the batch ``before``.

    The closed rows are written before the folders of their batches are deleted, so nothing is
    lost if this is interrupted. A reader that listed the old folders has to read again.
    """
    recent = os.path.join(_folder(root, mode), "recent")
    end = before // SPAN * SPAN
    first = _read(spark, recent).where(F.col("batch") < end).agg(F.min("batch").alias("first")).first()["first"]
    if first is None:
        return
    span = F.floor(F.col("batch") / SPAN)
    chosen = all_metrics(spark, root, mode).where((F.col("batch") < end) & (span >= first // SPAN))
    closing = materialize(chosen.withColumn("span", span), "closing")
    (
        closing.hint("rebalance", "span")
        .write.option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .partitionBy("span")
        .parquet(os.path.join(_folder(root, mode), "closed"))
    )
    for row in closing.select("batch").distinct().toLocalIterator():
        delete_folder(spark, os.path.join(recent, f"batch={row['batch']}"))


def read_metrics(spark: SparkSession, root: str, mode: str, newest: int | None = None) -> DataFrame:
    """The series of a mode in order; all of it, or the rows of the ``newest`` sequence numbers."""
    return latest_metrics(all_metrics(spark, root, mode), "seq", newest)


def latest_metrics(df: DataFrame, sequence: str, newest: int | None = None) -> DataFrame:
    """Rows ordered by a sequence number that may be stored as text, then by all other columns.

    With ``newest``, only those of that many of the highest numbers; rows that share a number stay
    together, so a batch is never cut.
    """
    number = F.col(sequence).try_cast("bigint")
    chosen = df
    if newest is not None:
        highest = df.select(number.alias("__number")).distinct().orderBy(F.desc_nulls_last("__number")).limit(newest)
        chosen = df.join(F.broadcast(highest.agg(F.min("__number").alias("__least"))), number >= F.col("__least")).drop("__least")
    return chosen.orderBy(number, *[c for c in df.columns if c != sequence])


def purge_metrics(spark: SparkSession, root: str, mode: str) -> None:
    """Delete the series of one mode and leave an empty table; other modes are untouched."""
    empty = spark.createDataFrame([], METRIC_SCHEMA)
    (
        empty.write.option("partitionOverwriteMode", "static")
        .mode("overwrite")
        .partitionBy("batch")
        .parquet(_folder(root, mode))
    )
