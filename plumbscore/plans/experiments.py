"""Live experiments: A/B tests that may be looked at every window, and bandits that see only the chosen arm."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbscore.operators.running import Running, running
from plumbscore.plans.deployment import hedge_splits
from plumbscore.session import materialize


def ab_sequential(
    rates: DataFrame,
    models: Sequence[str],
    time: str = "date",
    model: str = "model",
    tau: float = 0.1,
    level: float = 0.05,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every pair of the named variants after every window, with p-values that stay valid however often they are read.

    ``keys`` tell tests apart that run side by side; a test without rows in a window has no result for it.

    ``rates`` holds ``n`` and ``conversions`` per window and variant. Both are added up to the window, and
    the difference of the rates is tested by a mixture likelihood ratio with a normal mixture of deviation ``tau``
    (Johari, Pekelis and Walsh, 2015): ``p`` is the smallest inverse of the ratio so far, 1 at most, so an error
    at any window at all is at most ``level``. ``adjusted`` corrects it over the pairs of a window by
    Holm's steps, and ``significant`` compares that with ``level``. A window in which a variant has no rows adds nothing to
    it; before both have rows, or while no row or every row converted, the ratio is 0 and ``difference`` may be null.
    """
    sides = []
    for i, name in enumerate(models):
        for kind, column in (("n", "n"), ("c", "conversions")):
            sides.append(F.coalesce(F.sum(F.when(F.col(model) == name, F.col(column))), F.lit(0)).cast("long").alias(f"__{kind}{i}"))
    pairs = [
        F.struct(
            F.lit(models[a]).alias("model_a"),
            F.lit(models[b]).alias("model_b"),
            *[F.col(f"__{kind}{i}").alias(f"__{kind}_{side}") for i, side in ((a, "a"), (b, "b")) for kind in ("n", "c")],
        )
        for a, b in combinations(range(len(models)), 2)
    ]
    wide = rates.where(F.col(time).isNotNull()).groupBy(time, *keys).agg(*sides).select(time, *keys, F.explode(F.array(*pairs)).alias("pair"))
    counted = [Running(name, f"__{name}", "sum") for name in ("n_a", "c_a", "n_b", "c_b")]
    added = running(wide.select(time, *keys, "pair.*"), time, counted, keys=[*keys, "model_a", "model_b"])

    n_a, c_a, n_b, c_b = (F.col(name) for name in ("n_a", "c_a", "n_b", "c_b"))
    pooled = F.try_divide(c_a + c_b, n_a + n_b)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b))
    measured = added.withColumn("difference", F.try_divide(c_a, n_a) - F.try_divide(c_b, n_b)).withColumn("__v", F.nullif(spread, F.lit(0.0)))
    v, t = F.col("__v"), F.lit(float(tau) ** 2)
    ratio = F.log(v / (v + t)) / 2 + t * F.pow("difference", F.lit(2)) / (2 * v * (v + t))
    # One row per window and pair is left, so plain windows serve.
    so_far = Window.partitionBy(*keys, "model_a", "model_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    valued = measured.withColumn("__ratio", ratio).withColumn("p", F.exp(-F.greatest(F.max("__ratio").over(so_far), F.lit(0.0))))
    ordered = Window.partitionBy(time, *keys).orderBy("p", "model_a", "model_b")
    left = F.count("*").over(Window.partitionBy(time, *keys)) + 1 - F.row_number().over(ordered)
    steps = valued.withColumn("__step", F.least(F.lit(1.0), left * F.col("p")))
    upward = ordered.rowsBetween(Window.unboundedPreceding, 0)
    held = steps.withColumn("adjusted", F.max("__step").over(upward))
    return held.select(time, *keys, "model_a", "model_b", "n_a", "n_b", "difference", "p", "adjusted", (F.col("adjusted") <= F.lit(float(level))).alias("significant"))


def logged_gains(
    logged: DataFrame, models: Sequence[str], reward: str | Column, propensity: str | Column, time: str = "date", model: str = "model"
) -> DataFrame:
    """``(time, model, n, paid, weight, gain)`` for every window and named model, of rows that each show one model's reward.

    ``propensity`` is the chance with which the row's model was chosen. ``paid`` sums reward over propensity, ``weight``
    one over propensity, and ``gain`` is ``paid`` over the rows of the window: an unbiased
    estimate of what the model would have earned on all of them, 0 without rows. Rows without a reward count as reward 0; rows
    without a window, and those of other models or without a positive propensity, are left out.
    """
    chance = F.col(propensity) if isinstance(propensity, str) else propensity
    earned = F.coalesce(F.col(reward) if isinstance(reward, str) else reward, F.lit(0)).cast("double")
    usable = logged.select(F.col(time).alias("__t"), F.col(model).alias("__m"), chance.cast("double").alias("__p"), earned.alias("__r"))
    usable = usable.where(F.col("__t").isNotNull() & F.col("__m").isin(list(models)) & (F.col("__p") > 0))
    summed = usable.groupBy("__t", "__m").agg(
        F.count("*").alias("n"), F.sum(F.col("__r") / F.col("__p")).alias("paid"), F.sum(1 / F.col("__p")).alias("weight")
    )
    own = [F.map_from_entries(F.collect_list(F.struct("__m", F.struct("n", "paid", "weight")))).alias("own"), F.sum("n").alias("all")]
    # A window has one row per model at most.
    windows = summed.groupBy("__t").agg(*own).select("__t", "own", "all", F.explode(F.array(*[F.lit(m) for m in models])).alias("__m"))
    known = windows.withColumn("__s", F.try_element_at("own", F.col("__m")))
    paid = F.coalesce(F.col("__s.paid"), F.lit(0.0))
    return known.select(
        F.col("__t").alias(time),
        F.col("__m").alias(model),
        F.coalesce(F.col("__s.n"), F.lit(0).cast("long")).alias("n"),
        paid.alias("paid"),
        F.coalesce(F.col("__s.weight"), F.lit(0.0)).alias("weight"),
        (paid / F.col("all")).alias("gain"),
    )


def partial_splits(gains: DataFrame, eta: float = 1.0, mix: float = 0.1, time: str = "date", model: str = "model") -> DataFrame:
    """``gains`` plus ``split``, the traffic share that Exp3 gives each model after the windows before.

    Shares follow the exponential weights of the gains so far (Auer and others, 2002), and ``mix`` of
    the traffic is shared equally, so that every model keeps a propensity by which its rewards can be weighted.
    """
    gains = materialize(gains, "gains")
    weighed = hedge_splits(gains, eta, time, model, "gain").select(time, model, F.col("split").alias("__split"))
    size = F.count("*").over(Window.partitionBy(time))
    return gains.join(weighed, [time, model]).withColumn("split", (1 - F.lit(float(mix))) * F.col("__split") + F.lit(float(mix)) / size).drop("__split")


def policy_values(splits: DataFrame, time: str = "date") -> DataFrame:
    """``(time, n, equal_value, value, scaled_value)``: what the shares would have earned per row, told from another policy's log.

    ``value`` weights each logged reward by share over propensity and is unbiased; ``scaled_value`` divides by
    the sum of these weights instead of the rows, which varies less, and is null if no weight is there.
    ``equal_value`` is the estimate for equal shares.
    """
    paid = F.sum(F.col("split") * F.col("paid"))
    return splits.groupBy(time).agg(
        F.sum("n").alias("n"),
        F.avg("gain").alias("equal_value"),
        F.try_divide(paid, F.sum("n")).alias("value"),
        F.try_divide(paid, F.sum(F.col("split") * F.col("weight"))).alias("scaled_value"),
    )
