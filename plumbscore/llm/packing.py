"""Packing into length buckets of least padding and batches of a token budget.

Documents longer than the longest sequence are cut into sequences, so lengths are bounded.
A dynamic programme over the global histogram of lengths finds the bucket boundaries that
need the fewest padding tokens. Inside a bucket, sequences get consecutive places, and as many
as the budget allows at the padded length share a batch. Places are counted in two steps,
within slices of a bucket and over the slices, so a bucket with most rows is no single task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table, text_of
from plumbscore.session import materialize

MAX_TOKENS = 2048
BUCKETS = 16
BUDGET = 65_536
ROWS_PER_SLICE = 50_000


def token_count(text: str = "text") -> Column:
    """Words, numbers and single other signs; null and white space give none."""
    return F.regexp_count(text_of(text), F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` rise and are distinct. ``cost[k][j]`` is the least padding of the first ``j``
    lengths in ``k`` buckets; the last bucket runs from ``i`` to ``j`` and pads to length ``j``.
    Of equal costs the fewest buckets and the earliest cuts are taken.
    """
    n = len(lengths)
    if not n:
        return []
    size = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate(([0.0], np.cumsum(np.asarray(counts, dtype=np.float64))))
    tokens = np.concatenate(([0.0], np.cumsum(size * np.asarray(counts, dtype=np.float64))))
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    cuts: list[np.ndarray] = []
    totals = []
    for _ in range(min(buckets, n)):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        after[0] = 0.0
        for j in range(1, n + 1):
            options = cost[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(options))
            after[j] = options[cut[j]]
        cuts.append(cut)
        totals.append(after[n])
        cost = after
    used = int(np.argmin(totals)) + 1
    bounds, j = [], n
    for cut in reversed(cuts[:used]):
        if not j:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def sequences(docs: DataFrame, keep: list[str], tokens: Column, longest: int = MAX_TOKENS) -> DataFrame:
    """``keep`` plus ``piece``, ``start`` and ``n_tokens``: one row per sequence.

    Documents without tokens give none. ``piece`` counts from 0 within the document, and all
    but its last sequence have ``longest`` tokens.
    """
    sized = docs.select(*keep, tokens.alias("__tokens")).where("__tokens > 0")
    last = F.expr(f"CAST((__tokens - 1) DIV {longest} AS INT)")
    cut = sized.select(*keep, "__tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * longest
    return cut.select(*keep, "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("__tokens") - start).alias("n_tokens"))


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokens: Column | None = None,
    longest: int = MAX_TOKENS,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """One row per sequence with its bucket, batch and place in the batch.

    Columns: ``key``, ``piece``, ``start`` and ``n_tokens`` (the span in tokens), ``padded`` (the
    boundary of its bucket), ``batch`` (counted from 0 within the bucket) and ``slot``. A batch has ``budget // padded``
    sequences, at least one; only the last of a bucket can have fewer. Rows that repeat are
    separate sequences; those of one key and piece take places by their length.
    """
    if longest < 1 or buckets < 1 or budget < 1:
        raise ValueError("longest, buckets and budget must be at least 1")
    cut = materialize(sequences(docs, [key], token_count(text) if tokens is None else tokens, longest), "sequences")
    # At most ``longest`` rows.
    histogram = sorted((r[0], r[1]) for r in cut.groupBy("n_tokens").count().collect())
    bounds = best_boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    rows = sum(r[1] for r in histogram)
    padded = F.lit(None).cast("long")
    for bound in reversed(bounds):
        padded = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(padded)
    slices = max(1, math.ceil(rows / rows_per_slice))
    placed = cut.withColumn("padded", padded).withColumn("__slice", F.pmod(F.xxhash64(key, "piece"), F.lit(slices)))
    order = Window.partitionBy("padded", "__slice").orderBy(F.xxhash64(key, "piece"), key, "piece", "n_tokens")
    local = placed.withColumn("__place", F.row_number().over(order) - 1)
    # One row per bucket and slice: a small table, a part of a hundred thousandth of the rows at full size.
    sizes = placed.groupBy("padded", "__slice").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("padded").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("padded", "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    ranked = local.join(offsets, ["padded", "__slice"]).withColumn("__rank", F.col("__place") + F.col("__before"))
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L DIV padded"))
    return ranked.withColumn("__each", each).select(
        key, "piece", "start", "n_tokens", "padded", F.expr("__rank DIV __each").alias("batch"), F.expr("CAST(__rank % __each AS INT)").alias("slot")
    )


@query("op10_packing_length_buckets")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into sequences, with the bucket and batch of each."""
    return pack(table(spark, folder, "documents"))
