"""Streams of rows from files, and watermarked score counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbscore.operators.curves import binary_counts
from plumbscore.sources.files import LoadSpec


def parquet_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_trigger: int | None = 1,
    pattern: str | None = None,
) -> DataFrame:
    """Rows of the parquet files that appear in a folder; None takes all new files as one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def csv_stream(
    spark: SparkSession, spec: LoadSpec, schema: T.StructType, files_per_trigger: int = 1
) -> DataFrame:
    """Rows of the delimited files that appear in the folder of ``spec``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("header", spec.hasHeader)
        .option("sep", spec.sep)
        .csv(spec.filepath)
    )


def event_time(df: DataFrame, time: str) -> DataFrame:
    """``df`` with ``time`` as an instant, which watermarks need. Set the session zone to UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def score_counts(
    scored: DataFrame, time: str, period: str, lateness: str, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Streaming score counts per window; rows later than ``lateness`` are dropped.

    The state is one row per (window, key, score) until the watermark passes the window.
    Measures are not additive but counts are, so measures are computed from stored counts.
    """
    # The grouping must be on the window itself: its start alone does not carry the watermark.
    windowed = scored.withWatermark(time, lateness).withColumn("window", F.window(time, period))
    counts = binary_counts(windowed, keys=["window", *keys])
    return counts.select(F.col("window.start").alias("date"), *keys, "score", "p", "n")


def start_counts(
    counts: DataFrame, path: str, checkpoint: str, period_seconds: float | None = None
) -> StreamingQuery:
    """Append closed windows to a parquet table; without a period, process what is there and stop."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return trigger(writer, period_seconds).start(path)


def trigger(writer, period_seconds: float | None):
    """Every ``period_seconds``, or once over the available data."""
    if period_seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{period_seconds} seconds")


def stop(query: StreamingQuery, timeout_seconds: int = 60) -> None:
    """Stop a query and wait until it has ended."""
    query.stop()
    query.awaitTermination(timeout_seconds)
