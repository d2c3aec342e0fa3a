"""Counts of every window of a stream, open ones included, and a ledger of rows that came too late.

Score counts add up, so each micro-batch stores the counts of its own rows and nothing is kept in the state of the stream.
A batch writes to its own folder and replaces it when it is replayed, so no row counts twice. Measures of a window are those of its summed
counts, at any time: a window need not be closed to be read.

A window closes when ``lateness`` has passed since its end, by the largest time of the batches before. Rows of closed windows do
not change its counts any more; they are counted in the ledger instead, by window and key, so nothing gets lost unseen.

Below ``path``: ``counts/batch=n``, ``late/batch=n`` and ``ledger/batch=n`` (one row), and ``base/upto=n``, the sum of the counts of all batches
below ``n`` (see :meth:`WindowStore.compact`).
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbscore.operators.curves import binary_counts
from plumbscore.plans.deployment import metrics_of_counts
from plumbscore.session import delete_folder
from plumbscore.streaming.streams import trigger

LEDGER = "batch bigint, rows bigint, late bigint, untimed bigint, high timestamp, closed timestamp"
COUNTS = "score double, p bigint, n bigint"


@dataclass
class WindowStore:
    """Stored counts of the ``period`` windows of ``time``, by ``keys`` and score, of rows with ``score`` and ``y``.

    ``key_types`` are the types of ``keys``. Rows without a time have no window; the ledger counts them.
    """

    path: str
    time: str
    period: str
    lateness: str
    keys: Sequence[str] = ("model",)
    key_types: Sequence[str] = ("string",)
    score: str = "score"
    y: str = "y"

    def _folder(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _schema(self, measures: str) -> T.StructType:
        keys = ", ".join(f"`{k}` {t}" for k, t in zip(self.keys, self.key_types, strict=True))
        return T.StructType.fromDDL(f"date timestamp, {keys}, {measures}" if keys else f"date timestamp, {measures}")

    def _read(self, spark: SparkSession, schema: T.StructType, *parts: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("basePath", self._folder(parts[0])).parquet(self._folder(*parts))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, *parts: str) -> None:
        df.write.mode("overwrite").parquet(self._folder(*parts))

    def _window(self) -> Column:
        return F.window(self.time, self.period)

    def _high_before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """One row: the largest time of the batches before, from the ledger of the last of them."""
        schema = T.StructType.fromDDL(LEDGER)
        before = self._read(spark, schema, "ledger", f"batch={batch_id - 1}")
        if batch_id > 0 and before.isEmpty():
            before = self.ledger(spark).where(F.col("batch") < batch_id)
        return before.agg(F.max("high").alias("high"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Store the counts of one micro-batch, then its late rows, then its line of the ledger."""
        spark, rows = batch.sparkSession, batch.withColumn(self.time, F.col(self.time).cast("timestamp")).persist()
        try:
            before = self._high_before(spark, batch_id)
            closed = before.select("high", (F.col("high") - F.expr(f"INTERVAL {self.lateness}")).alias("closed"))
            known = rows.where(F.col(self.time).isNotNull()).withColumn("window", self._window()).crossJoin(F.broadcast(closed))
            late = F.coalesce(F.col("window.end") <= F.col("closed"), F.lit(False))
            placed = known.withColumn("__late", late).withColumn("date", F.col("window.start")).drop("window", "high", "closed")
            counts = binary_counts(placed.where(~F.col("__late")), self.score, self.y, ["date", *self.keys])
            self._write(counts.select("date", *self.keys, F.col(self.score).cast("double").alias("score"), "p", "n"), "counts", f"batch={batch_id}")
            missed = placed.where("__late").groupBy("date", *self.keys).agg(F.count("*").alias("late"))
            self._write(missed, "late", f"batch={batch_id}")
            summed = placed.agg(F.count("*").alias("timed"), F.count_if("__late").alias("late"), F.max(self.time).alias("most"))
            line = summed.crossJoin(rows.agg(F.count("*").alias("rows"))).crossJoin(closed)
            self._write(
                line.select("rows", "late", (F.col("rows") - F.col("timed")).alias("untimed"), F.greatest("high", "most").alias("high"), "closed"), "ledger", f"batch={batch_id}"
            )
        finally:
            rows.unpersist()

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row per batch: its rows, those that were late or had no time, the largest time so far, and what was closed when it came."""
        return self._read(spark, T.StructType.fromDDL(LEDGER), "ledger")

    def _bases(self, spark: SparkSession) -> list[int]:
        """The finished sums, oldest first. A sum without its marker was interrupted and does not count."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(self._folder("base", "upto=*", "_SUCCESS"))
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().removeprefix("upto=")) for f in found or ())

    def counts(self, spark: SparkSession) -> DataFrame:
        """``(date, keys, score, p, n)`` of all batches; a score may have several rows."""
        base = (self._bases(spark) or [0])[-1]
        recent = self._read(spark, self._schema(f"{COUNTS}, batch bigint"), "counts").where(F.col("batch") >= base).drop("batch")
        schema = self._schema(COUNTS)
        return recent.unionAll(self._read(spark, schema, "base", f"upto={base}").select(*schema.names)) if base else recent

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """``(date, keys, late)``: how many rows came after their window had closed."""
        found = self._read(spark, self._schema("late bigint"), "late")
        return found.groupBy("date", *self.keys).agg(F.sum("late").alias("late"))

    def metrics(self, spark: SparkSession) -> DataFrame:
        """The binary summary of every window and key, with ``late`` rows and whether the window ``is_open``.

        A window of which all rows came late has no summary, only its late rows.
        """
        measured = metrics_of_counts(self.counts(spark), ["date", *self.keys])
        both = measured.join(self.late_rows(spark), ["date", *self.keys], "full").withColumn("late", F.coalesce("late", F.lit(0).cast("bigint")))
        now = self.ledger(spark).agg((F.max("high") - F.expr(f"INTERVAL {self.lateness}")).alias("__closed"))
        opened = F.col("date") + F.expr(f"INTERVAL {self.period}") > F.col("__closed")
        return both.crossJoin(F.broadcast(now)).withColumn("is_open", opened).drop("__closed")

    def compact(self, spark: SparkSession, before: int) -> None:
        """Sum the counts of all batches below ``before`` into one table.

        The sum counts from the moment its marker is written. What it replaces is kept until the next call, so a reader
        that listed the folders before still reads them, and a crash at any step loses nothing and counts nothing twice.
        """
        bases = self._bases(spark)
        if before <= (bases or [0])[-1]:
            return
        schema = self._schema(COUNTS)
        last = (bases or [0])[-1]
        recent = self._read(spark, self._schema(f"{COUNTS}, batch bigint"), "counts")
        chosen = recent.where((F.col("batch") >= last) & (F.col("batch") < before)).drop("batch")
        if last:
            chosen = chosen.unionAll(self._read(spark, schema, "base", f"upto={last}").select(*schema.names))
        summed = chosen.groupBy("date", *self.keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        self._write(summed.hint("rebalance"), "base", f"upto={before}")
        for old in bases[:-1]:
            delete_folder(spark, self._folder("base", f"upto={old}"))
        stale = recent.where(F.col("batch") < last).select("batch").distinct()
        for row in stale.toLocalIterator():
            delete_folder(spark, self._folder("counts", f"batch={row['batch']}"))


def start_windows(stream: DataFrame, store: WindowStore, checkpoint: str, period_seconds: float | None = None) -> StreamingQuery:
    """Keep ``store`` up to date with a stream of scored rows; without a period, process what is there and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.process)
    return trigger(writer, period_seconds).start()
