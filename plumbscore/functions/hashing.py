"""Reproducible pseudo-random numbers and weighted choices keyed on row values.

``rand`` and ``randomSplit`` change with the partitioning of the input; a hash of the row
key does not, needs no shuffle, and gives the same answer on a retried task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*keys: str | Column, salt: str = "") -> Column:
    """Number in [0, 1) from the first 32 bits of md5("salt:key1:key2...").

    Different salts give independent numbers for one key. Null keys count as empty text.
    """
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(salt), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normalise_weights(weights: Sequence[float | str]) -> list[float]:
    """Weights scaled to sum to one; raises unless all are >= 0 with a positive sum."""
    numbers = [float(w) for w in weights]
    if any(math.isnan(w) or math.isinf(w) or w < 0 for w in numbers):
        raise ValueError(f"weights must be finite and not negative: {numbers}")
    total = math.fsum(numbers)
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    return [w / total for w in numbers]


def cumulative_bounds(weights: Sequence[float | str]) -> list[float]:
    """Upper bounds of consecutive intervals of [0, 1]; the last bound is exactly 1."""
    shares = normalise_weights(weights)
    bounds = [math.fsum(shares[: i + 1]) for i in range(len(shares))]
    last = max(i for i, share in enumerate(shares) if share > 0)
    return bounds[:last] + [1.0] * (len(bounds) - last)


def pick_by_weight(uniform: Column, names: Sequence[str], weights: Sequence[float | str]) -> Column:
    """The first name whose cumulative weight exceeds ``uniform``."""
    if not names or len(names) != len(weights):
        raise ValueError("give one weight per name")
    choice = None
    for name, bound in zip(names, cumulative_bounds(weights)):
        hit = uniform < F.lit(bound)
        choice = F.when(hit, F.lit(name)) if choice is None else choice.when(hit, F.lit(name))
    return choice


def weight_sum(column: str) -> Column:
    """Sum of a comma-separated weight text; null when an entry is no number."""
    numbers = F.transform(F.split(F.col(column), ","), lambda item: F.trim(item).try_cast("double"))
    return F.aggregate(numbers, F.lit(0.0), lambda total, item: total + item)
