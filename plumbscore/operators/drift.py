"""Shift of model inputs: the distribution of each feature now against that of the training rows.

A distribution is kept as a mergeable quantile sketch (KLL, Karnin, Lang and Liberty, 2016), a few kilobytes whatever
the number of rows. Sketches of parts of a table, of windows or of micro-batches merge to that of the whole, so one pass with
partial aggregates makes them, and no rows are kept to compare later. With at most ``k`` values a sketch is exact; beyond, a rank is off
by about ``2.3 / k ** 0.97`` at a confidence of 99 %.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2048
POINTS = 256
BINS = 16
ALPHA = 0.01
PSI_LIMIT = 0.2  # Fixed value: a population stability index beyond it is commonly called a major shift.


ERROR_SCALE, ERROR_POWER = 2.296, 0.9723  # Fixed values: the published fit of the rank error of KLL sketches.


def rank_error(k: int) -> float:
    """How far a rank of a sketch of more than ``k`` values may be off, at a confidence of 99 %."""
    return ERROR_SCALE / k**ERROR_POWER


def input_sketches(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), k: int = K) -> DataFrame:
    """``(keys, feature, sketch, k, rows, n)``: one sketch per feature of each group, in one pass.

    ``rows`` counts the rows and ``n`` those with a value; null and NaN are gaps. Groups come from the data: an empty table has none.
    """
    numbers = [F.col(f).cast("double") for f in features]
    known = [F.when(~F.isnan(x), x) for x in numbers]
    made = [F.kll_sketch_agg_double(x, F.lit(k)).alias(f"__sketch_{i}") for i, x in enumerate(known)]
    counted = [F.count(x).alias(f"__n_{i}") for i, x in enumerate(known)]
    found = df.groupBy(*(keys or [F.lit(0).alias("__all")])).agg(F.count("*").alias("rows"), *made, *counted)
    entries = [F.struct(F.lit(f).alias("feature"), F.col(f"__sketch_{i}").alias("sketch"), F.col(f"__n_{i}").alias("n")) for i, f in enumerate(features)]
    long = found.select(*keys, "rows", F.explode(F.array(*entries)).alias("e"))
    return long.select(*keys, "e.feature", "e.sketch", F.lit(k).alias("k"), "rows", "e.n")


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sketches of disjoint rows as one per ``keys`` and feature; the smallest ``k`` of them decides the error."""
    merged = sketches.groupBy(*keys, "feature").agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.min("k").alias("k"), F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    return merged.select(*keys, "feature", "sketch", "k", "rows", "n")


def _quantiles(sketch: str, parts: int) -> Column:
    """The quantiles at all multiples of one in ``parts``, from the first to the largest value."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / parts) for i in range(1, parts + 1)]))


def input_shift(
    baseline: DataFrame, current: DataFrame, keys: Sequence[str] = (), alpha: float = ALPHA, psi_limit: float = PSI_LIMIT, points: int = POINTS, bins: int = BINS
) -> DataFrame:
    """``(keys, feature, n_base, n, gap_base, gap, ks, ks_limit, psi, shifted)`` for each group of ``current`` sketches.

    ``ks`` is the two-sample Kolmogorov-Smirnov distance of the distributions that ``points`` quantiles of each side draw, so it is off by
    one in ``points`` at most. ``ks_limit`` is what chance exceeds in a share ``alpha`` of the cases, plus that one and the rank errors of sketches that are not exact.
    ``psi`` is the population stability index over ``bins`` baseline quantiles and the gaps, with half a row added to each cell. A feature is
    ``shifted`` if one of the two exceeds its limit. Features that only one side has are left out; with no value on one side ``ks`` is null
    and the gaps decide.
    """
    base = baseline.select(
        "feature", F.col("sketch").alias("__base"), F.col("k").alias("__k_base"), F.col("rows").alias("__rows_base"), F.col("n").alias("n_base")
    )
    both = current.join(base, "feature").withColumn("__full", (F.col("n") > 0) & (F.col("n_base") > 0))
    # A sketch without values has no quantiles to ask for. Ranks can be asked for at fixed places only, so they come from quantiles.
    none = F.array().cast("array<double>")
    both = both.withColumns(
        {
            "__base": F.when(F.col("n_base") > 0, _quantiles("__base", points)).otherwise(none),
            "__now": F.when(F.col("n") > 0, _quantiles("sketch", points)).otherwise(none),
            "__cuts": F.when(F.col("n_base") > 0, F.array_distinct(F.slice(_quantiles("__base", bins), 1, bins - 1))).otherwise(none),
        }
    ).withColumn("__grid", F.array_distinct(F.concat("__base", "__now")))

    def ranks(quantiles: str, at: str) -> Column:
        """The share of values up to each place, to a whole number of quantiles; 0 without values."""
        return F.transform(at, lambda x: F.size(F.filter(quantiles, lambda v: v <= x)) / points)

    distances = F.zip_with(ranks("__base", "__grid"), ranks("__now", "__grid"), lambda a, b: F.abs(a - b))
    def error(n: str, k: str) -> Column:
        return F.when(F.col(n) > F.col(k), F.lit(ERROR_SCALE) / F.pow(F.col(k).cast("double"), F.lit(ERROR_POWER))).otherwise(0.0)

    limit = F.lit(math.sqrt(-0.5 * math.log(alpha / 2))) * F.sqrt(1 / F.col("n") + 1 / F.col("n_base")) + 1 / points + error("n", "k") + error("n_base", "__k_base")

    def shares(quantiles: str, n: str, rows: str) -> Column:
        """The rows of each cell and of the gaps, as smoothed shares."""
        up_to = F.concat(ranks(quantiles, "__cuts"), F.array(F.when(F.col(n) > 0, 1.0).otherwise(0.0)))
        inside = F.transform(up_to, lambda x, i: (x - F.when(i > 0, F.get(up_to, i - 1)).otherwise(0.0)) * F.col(n))
        cells = F.concat(inside, F.array((F.col(rows) - F.col(n)).cast("double")))
        return F.transform(cells, lambda c: (c + 0.5) / (F.col(rows) + 0.5 * (F.size("__cuts") + 2)))

    both = both.withColumns({"__p": shares("__base", "n_base", "__rows_base"), "__q": shares("__now", "n", "rows")})
    psi = F.aggregate(F.zip_with("__p", "__q", lambda p, q: (p - q) * F.log(p / q)), F.lit(0.0), lambda total, x: total + x)
    found = both.select(
        *keys,
        "feature",
        "n_base",
        "n",
        (1 - F.col("n_base") / F.col("__rows_base")).alias("gap_base"),
        (1 - F.col("n") / F.col("rows")).alias("gap"),
        F.when(F.col("__full"), F.array_max(distances)).alias("ks"),
        F.when(F.col("__full"), limit).alias("ks_limit"),
        psi.alias("psi"),
    )
    return found.withColumn("shifted", F.coalesce(F.col("ks") > F.col("ks_limit"), F.lit(False)) | (F.col("psi") > F.lit(psi_limit)))
