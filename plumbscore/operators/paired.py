"""Whether one model ranks better than another on the same rows: the paired test of DeLong, DeLong and Clarke-Pearson (1988).

The placement of a positive row is the share of negatives that score below it, that of a negative row the share of positives that score above
it, ties by half. The mean placement of either class is the AUC, and the variances of the differences of
placements give the standard error of a difference of AUCs. Placements follow from counts per score, so no pair of rows is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbscore.operators.curves import binary_counts, threshold_curve
from plumbscore.operators.joins import broadcast_if_small, join_same
from plumbscore.operators.running import ROWS_PER_SLICE
from plumbscore.session import materialize

Z_95 = 1.959963984540054  # Fixed value: two-sided 95% point of the normal distribution.
PLACEMENT_BYTES = 128


def placements(counts: DataFrame, keys: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``(keys, score, of_positive, of_negative)``: the placement of a row of either class with that score.

    ``counts`` has one row per key and score with ``p`` positives and ``n`` negatives. Without rows of the other class a placement is null.
    """
    curve = threshold_curve(counts, keys, rows_per_slice)
    of_positive = F.try_divide(F.col("neg") - F.col("fp") + F.col("n") / 2, F.col("neg"))
    of_negative = F.try_divide(F.col("tp") - F.col("p") / 2, F.col("pos"))
    return curve.select(*keys, F.col("threshold").alias("score"), of_positive.alias("of_positive"), of_negative.alias("of_negative"))


def compare_aucs(
    scored: DataFrame,
    key: str,
    models: Sequence[str],
    by: Sequence[str] = (),
    model: str = "model",
    score: str = "score",
    y: str = "y",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``(by, model_a, model_b, rows, difference, z, significant)`` for every pair of ``models`` in each group.

    ``scored`` has a row per ``key`` and model. Only rows with a label and a score, not NaN, of every model are compared, so all models are
    measured on the same ``rows``; a key that repeats with a model counts once, with its largest score. ``z`` is null
    where placements do not vary: with fewer than two rows of a class, or equal models.
    """
    if len(set(models)) < 2:
        raise ValueError("give at least two different models")
    real = scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    sides = [F.max(F.when(F.col(model) == name, F.col(score).cast("double"))).alias(f"__s{i}") for i, name in enumerate(models)]
    wide = real.groupBy(*by, key).agg(F.max(F.col(y).cast("double")).alias("__y"), *sides).dropna(subset=[f"__s{i}" for i in range(len(models))])
    wide = materialize(wide.drop(key), "paired")
    entries = [F.struct(F.lit(i).alias("__m"), F.col(f"__s{i}").alias("score")) for i in range(len(models))]
    long = wide.select(*by, F.col("__y").alias("y"), F.explode(F.array(*entries)).alias("e")).select(*by, "y", "e.*")
    placed = materialize(placements(binary_counts(long, keys=[*by, "__m"]), [*by, "__m"], rows_per_slice), "placements")
    positive = F.col("__y") > 0.5
    for i in range(len(models)):
        own = placed.where(F.col("__m") == i).select(*by, F.col("score").alias(f"__s{i}"), "of_positive", "of_negative")
        # A score that many rows share has one row here, so adaptive execution can split it where it is not broadcast.
        wide = join_same(wide, broadcast_if_small(own, PLACEMENT_BYTES), [*by, f"__s{i}"])
        wide = wide.withColumn(f"__v{i}", F.when(positive, F.col("of_positive")).otherwise(F.col("of_negative"))).drop("of_positive", "of_negative")

    pairs, aggregates = list(combinations(range(len(models)), 2)), [F.count("*").alias("rows")]
    for a, b in pairs:
        apart = F.col(f"__v{a}") - F.col(f"__v{b}")
        for name, kind in (("p", positive), ("n", ~positive)):
            aggregates.append(F.try_divide(F.var_samp(F.when(kind, apart)), F.count(F.when(kind, apart))).alias(f"__{name}{a}_{b}"))
        aggregates.append(F.avg(F.when(positive, apart)).alias(f"__d{a}_{b}"))
    summed = wide.groupBy(*by).agg(*aggregates)

    def line(a: int, b: int) -> Column:
        # Rounding leaves a variance of nothing slightly above 0.
        error = F.sqrt(F.greatest(F.col(f"__p{a}_{b}") + F.col(f"__n{a}_{b}"), F.lit(0.0)))
        known = F.when((error > 1e-12) & ~F.isnan(error), F.col(f"__d{a}_{b}") / error)
        return F.struct(F.lit(models[a]).alias("model_a"), F.lit(models[b]).alias("model_b"), "rows", F.col(f"__d{a}_{b}").alias("difference"), known.alias("z"))

    found = summed.where("rows > 0").select(*by, F.explode(F.array(*[line(a, b) for a, b in pairs])).alias("pair"))
    return found.select(*by, "pair.*").withColumn("significant", F.abs("z") > F.lit(Z_95))
