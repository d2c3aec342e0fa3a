"""Periodic evaluation of deployed models, one micro-batch per period."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbscore.functions import normalise_weights
from plumbscore.operators.curves import binary_metrics
from plumbscore.operators.drift import K, input_shift, input_sketches
from plumbscore.operators.sampling import assign, period_sample, traffic_models
from plumbscore.plans.deployment import ab_compare, ab_rates, baseline_silhouette
from plumbscore.plans.training import CLUSTERERS, score
from plumbscore.session import materialize, scratch
from plumbscore.sources.metric_store import MODES, SPAN, all_metrics, append_metrics, batch_metrics, compact_metrics
from plumbscore.streaming.streams import trigger

Scorer = Callable[[DataFrame], DataFrame]
"""Adds a ``score`` column to a table and keeps its rows and other columns."""


def model_scorer(model: PipelineModel, positive_label: int = 0) -> Scorer:
    """Score with a fitted pipeline."""
    return lambda df: score(model, df, "score", positive_label)


@dataclass
class Monitor:
    """Evaluates every batch of a stream under one deployment mode.

    ``champion`` scores every row with every model and keeps the best model in force for the
    next batch. ``abtesting`` sends each row to one model by fixed weights. ``multiarm`` does
    so with weights learnt from the earlier batches: exponential weights of the summed AUC,
    mixed with ``explore`` of equal traffic so that each model keeps being measured (Exp3,
    Auer et al., 2002). A model without traffic in a batch counts as chance, 0.5.

    ``abtesting`` also stores ``n``, ``conversions`` and ``rate`` per model, and ``difference``,
    ``z`` and ``significant`` (0 or 1) under ``first:second`` for every pair of models. A row is
    converted if the SQL condition ``converted`` holds, or if ``y`` is above one half without one.

    With ``canary``, a fitted clustering or its centres, the silhouette of each batch is stored,
    and with ``baseline``, that of the training rows, its ``drift`` and whether it ``drifted`` by more
    than ``tolerance`` either way (0 or 1).

    With ``inputs``, the stored sketches of the training rows, the batch's own sketches are compared with them: ``ks``,
    ``psi`` and ``shifted`` (0 or 1) of each feature are stored under ``input:feature``.

    Batches depend on the stored rows of earlier batches only, so a replayed batch writes
    the same rows again. The scratch tables of a batch are deleted when it ends, and stored
    batches are compacted, so a monitor can run for months.
    """

    mode: str
    scorers: Mapping[str, Scorer]
    store: str
    key: str
    time: str
    y: str = "y"
    weights: Sequence[float] | None = None
    eta: float = 1.0
    explore: float = 0.1
    canary: PipelineModel | Sequence[Sequence[float]] | None = None
    canary_features: Sequence[str] = ()
    baseline: float | None = None
    tolerance: float = 0.1
    converted: str | None = None
    inputs: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}, expected one of {MODES}")
        self.names = traffic_models(list(self.scorers))
        if not self.names:
            raise ValueError("at least one model must take traffic")
        if self.weights is None:
            self.weights = [1.0] * len(self.names)
        if len(self.weights) != len(self.names):
            raise ValueError("give one weight per model")
        self.weights = normalise_weights(self.weights)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Evaluate one micro-batch and store its metrics."""
        spark, rows = batch.sparkSession, batch.persist()
        try:
            date = rows.agg(F.max(self.time).cast("timestamp_ntz").alias("date")).first()["date"]
            if date is None:
                return
            with scratch(spark, "monitor"):
                found = self._measure(rows, batch_id) + self._canary(rows) + self._shifts(rows)
            table = spark.createDataFrame(found, "model string, metric string, value double")
            numbered = table.withColumn("seq", F.lit(batch_id).cast("bigint")).withColumn(
                "date", F.lit(date.isoformat()).cast("timestamp_ntz")
            )
            append_metrics(numbered, self.store, self.mode, batch_id)
            if batch_id > 0 and batch_id % SPAN == 0:
                with scratch(spark, "compaction"):
                    compact_metrics(spark, self.store, self.mode, batch_id)
        finally:
            rows.unpersist()

    def _measure(self, rows: DataFrame, batch_id: int) -> list[tuple[str, str, float]]:
        earlier = self._earlier(rows, batch_id)
        if self.mode == "champion":
            aucs = self._aucs(self._scored(rows))
            found = [(name, "auc", value) for name, value in aucs.items()]
            if aucs:
                winner = min(aucs, key=lambda name: (-aucs[name], name))
                found.append((winner, "winner", aucs[winner]))
            return found + [(name, "champion", value) for (name, metric), value in earlier.items() if metric == "winner"]

        gains = {name: earlier.get((name, "gain"), 0.0) for name in self.names}
        shares = self.splits(gains) if self.mode == "multiarm" else dict(zip(self.names, self.weights))
        routed = assign(rows, self.key, self.names, [shares[n] for n in self.names], f"{self.mode}-{batch_id}")
        # Written first: filters on the score would otherwise hash the key again for every model and condition.
        aucs = self._aucs(materialize(self._scored(routed, routed=True), "routed"))
        found = [(name, "auc", value) for name, value in aucs.items()]
        found += [(name, "split", shares[name]) for name in self.names]
        if self.mode == "multiarm":
            found += [(name, "gain", gains[name] + aucs.get(name, 0.5)) for name in self.names]
        else:
            found += self._compared(routed)
        return found

    def splits(self, gains: Mapping[str, float]) -> dict[str, float]:
        """Traffic shares for the summed AUC of each model."""
        top = max(gains.values())
        grown = {name: math.exp(self.eta * (gain - top)) for name, gain in gains.items()}
        total = math.fsum(grown.values())
        floor = self.explore / len(grown)
        return {name: (1 - self.explore) * value / total + floor for name, value in grown.items()}

    def _earlier(self, rows: DataFrame, batch_id: int) -> dict[tuple[str, str], float]:
        """The stored rows of the last batch before this one: a few per model."""
        spark = rows.sparkSession
        found = batch_metrics(spark, self.store, self.mode, batch_id - 1).collect()
        if not found and batch_id > 0:
            # The batch before had no rows: look for the latest that did.
            stored = all_metrics(spark, self.store, self.mode).where(F.col("batch") < batch_id)
            last = stored.agg(F.max("batch").alias("last")).first()["last"]
            found = [] if last is None else stored.where(F.col("batch") == last).collect()
        return {(r["model"], r["metric"]): r["value"] for r in found}

    def _scored(self, rows: DataFrame, routed: bool = False) -> DataFrame:
        """``(model, score, y)`` by every model, or by the one a row was sent to, in one pass over the rows."""
        table, entries = rows, []
        for place, name in enumerate(self.names):
            output = f"__score_{place}"
            table = self.scorers[name](table).withColumnRenamed("score", output)
            entries.append(F.struct(F.lit(name).alias("model"), F.col(output).cast("double").alias("score")))
        y = F.col(self.y).alias("y")
        if routed:
            own = F.coalesce(*[F.when(F.col("model") == n, e["score"]) for n, e in zip(self.names, entries)])
            return table.select("model", own.alias("score"), y)
        return table.select(y, F.explode(F.array(*entries)).alias("__entry")).select("__entry.*", "y")

    def _compared(self, routed: DataFrame) -> list[tuple[str, str, float]]:
        """Rates of the models and the comparison of every pair: a few rows."""
        converted = F.expr(self.converted) if self.converted else F.col(self.y) > 0.5
        rates = ab_rates(routed, converted, keys=()).collect()
        found = [(r["model"], name, r[name]) for r in rates for name in ("n", "conversions", "rate")]
        if rates and len(self.names) > 1:
            table = routed.sparkSession.createDataFrame(rates, "model string, n bigint, conversions bigint, rate double")
            for pair in ab_compare(table, self.names).collect():
                both = f"{pair['model_a']}:{pair['model_b']}"
                found += [(both, name, pair[name]) for name in ("difference", "z", "significant")]
        return [(model, name, float(value)) for model, name, value in found if value is not None]

    def _aucs(self, scored: DataFrame) -> dict[str, float]:
        """AUC of each model on its own rows, in one job."""
        return {r["model"]: r["auc"] for r in binary_metrics(scored, keys=["model"]).select("model", "auc").collect()}

    def _canary(self, rows: DataFrame) -> list[tuple[str, str, float]]:
        if self.canary is None:
            return []
        name, value = CLUSTERERS[0], baseline_silhouette(rows, self.canary_features, self.canary)
        found = [(name, "silhouette", value)]
        if value is not None and self.baseline is not None:
            drift = value - self.baseline
            found += [(name, "drift", drift), (name, "drifted", float(abs(drift) > self.tolerance))]
        return found

    def _shifts(self, rows: DataFrame) -> list[tuple[str, str, float]]:
        """The shift of each input: three rows per feature."""
        if self.inputs is None:
            return []
        features = [r["feature"] for r in self.inputs.select("feature").collect()]
        k = self.inputs.agg(F.min("k")).first()[0] or K
        compared = input_shift(self.inputs, input_sketches(rows, features, k=k)).collect()
        found = [(f"input:{r['feature']}", name, r[name]) for r in compared for name in ("ks", "psi", "shifted")]
        return [(model, name, float(value)) for model, name, value in found if value is not None]


def start(
    stream: DataFrame, monitor: Monitor, checkpoint: str, period_seconds: float | None = None
) -> StreamingQuery:
    """Run a monitor on a stream, with its own checkpoint per mode below ``checkpoint``."""
    writer = (
        stream.writeStream.queryName(f"monitor-{monitor.mode}")
        .option("checkpointLocation", os.path.join(checkpoint, monitor.mode))
        .foreachBatch(monitor.process)
    )
    return trigger(writer, period_seconds).start()


def start_sampling(
    table: DataFrame, monitor: Monitor, fraction: float, checkpoint: str, period_seconds: float
) -> StreamingQuery:
    """Simulate a stream: every period, run the monitor on a fresh sample of a static table.

    Spark's rate source is the clock, and the number of its batch draws the sample, so a
    batch that is repeated after a failure draws the same rows.
    """
    clock = table.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()

    def process(_: DataFrame, batch_id: int) -> None:
        monitor.process(period_sample(table, monitor.key, batch_id, fraction), batch_id)

    writer = (
        clock.writeStream.queryName(f"sampling-{monitor.mode}")
        .option("checkpointLocation", os.path.join(checkpoint, f"sampling-{monitor.mode}"))
        .foreachBatch(process)
    )
    return trigger(writer, period_seconds).start()
