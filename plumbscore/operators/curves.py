"""Exact threshold curves of a binary score, for the whole table or per key.

``binary_counts`` shrinks the rows to one per (key, score). ``threshold_curve`` adds the
running counts. Every curve and summary below is a projection or one aggregate over that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbscore.operators.running import ROWS_PER_SLICE, Running, running


def score_pairs(
    scored: DataFrame,
    probability: str = "probability",
    label: str = "label",
    positive_label: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(score, y)`` for one class against the rest.

    The score is the probability of ``positive_label`` and y is 1 for its rows. Label 0 is
    the most frequent target value, which is the positive class unless told otherwise.
    """
    return scored.select(
        *keep,
        vector_to_array(probability)[positive_label].alias("score"),
        # A row without a label stays without one.
        F.when(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")), (F.col(label) == positive_label).cast("double")).alias("y"),
    )


def binary_counts(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Positives ``p`` and negatives ``n`` per key and distinct score; y > 0.5 is positive.

    Counts add up, so batches can be counted apart and summed. Rows whose score or label is
    null or NaN cannot stand on a curve and are left out; ``unscored`` counts them.
    """
    return (
        df.where(~_lacks(score) & ~_lacks(y))
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(y) > 0.5).alias("p"), F.count_if(F.col(y) <= 0.5).alias("n"))
    )


def unscored(df: DataFrame, score: str = "score", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows per key that lack a score or a label: null or NaN."""
    return df.groupBy(*keys).agg(F.count_if(_lacks(score) | _lacks(y)).alias("unscored"))


def _lacks(column: str) -> Column:
    return F.col(column).isNull() | F.isnan(F.col(column).cast("double"))


def threshold_curve(
    counts: DataFrame, keys: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Counts plus ``tp, fp`` at each threshold (score >= threshold) and the totals ``pos, neg``."""
    return running(
        counts.withColumnRenamed("score", "threshold"),
        order="threshold",
        values=[
            Running("tp", "p", "sum"),
            Running("fp", "n", "sum"),
            Running("pos", "p", "total"),
            Running("neg", "n", "total"),
        ],
        keys=keys,
        descending=True,
        rows_per_slice=rows_per_slice,
    )


def _share(part: Column, whole: Column, when_empty: float) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(F.lit(when_empty))


def _tpr() -> Column:
    return _share(F.col("tp"), F.col("pos"), 0.0)


def _fpr() -> Column:
    return _share(F.col("fp"), F.col("neg"), 0.0)


def _precision() -> Column:
    return _share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)


def _tp_before() -> Column:
    return F.col("tp") - F.col("p")


def _fp_before() -> Column:
    return F.col("fp") - F.col("n")


def _is_first() -> Column:
    return (_tp_before() + _fp_before()) == 0


def _f_score(beta: float = 1.0) -> Column:
    """F from whole counts with one division, so that equal values are equal numbers."""
    weight = F.lit(beta * beta)
    return F.try_divide((1 + weight) * F.col("tp"), weight * F.col("pos") + F.col("tp") + F.col("fp"))


def _with_ends(curve: DataFrame, keys: Sequence[str], point: Column, first: Column, last: Column | None) -> DataFrame:
    """One point per threshold, and the end points beside the first and the last threshold."""
    points = [point, F.when(_is_first(), first)]
    if last is not None:
        points.append(F.when(F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg"), last))
    return curve.select(*keys, F.explode(F.array_compact(F.array(*points))).alias("point")).select(*keys, "point.*")


def _point(threshold: Column, **values: Column) -> Column:
    return F.struct(threshold.alias("threshold"), *[v.alias(name) for name, v in values.items()])


def roc_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr)`` with (0, 0) at threshold infinity and (1, 1) at -infinity."""
    return _with_ends(
        curve,
        keys,
        _point(F.col("threshold"), fpr=_fpr(), tpr=_tpr()),
        _point(F.lit(float("inf")), fpr=F.lit(0.0), tpr=F.lit(0.0)),
        _point(F.lit(float("-inf")), fpr=F.lit(1.0), tpr=F.lit(1.0)),
    )


def pr_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(threshold, recall, precision)``, led by recall 0 with the first point's precision."""
    return _with_ends(
        curve,
        keys,
        _point(F.col("threshold"), recall=_tpr(), precision=_precision()),
        _point(F.lit(float("inf")), recall=F.lit(0.0), precision=_precision()),
        None,
    )


def f_points(curve: DataFrame, keys: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """``(threshold, f)``; F is 0 where precision and recall are both 0."""
    return curve.select(*keys, "threshold", _f_score(beta).alias("f"))


def ks_points(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(threshold, fpr, tpr, ks)`` including both end points."""
    return roc_points(curve, keys).withColumn("ks", F.col("tpr") - F.col("fpr"))


def binary_summary(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Areas, best F1 and best KS per key, in one aggregate.

    Equal F1 values resolve to the lowest threshold, equal KS values to the point furthest
    along the curve. Without negatives the ROC area is 1, without positives it is 0.
    """
    precision_before = F.when(_is_first(), _precision()).otherwise(_share(_tp_before(), _tp_before() + _fp_before(), 1.0))
    # Twice the trapezoid in whole numbers: exact in any order of summing, so equal models tie.
    roc_area = F.col("n").cast("decimal(18,0)") * (F.col("tp") + _tp_before()).cast("decimal(19,0)")
    pr_area = _share(F.col("p"), F.col("pos"), 0.0) * (precision_before + _precision()) / 2
    f1 = _f_score()
    best_f1 = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("negated")))
    # tpr - fpr times pos * neg: whole numbers, so equal distances tie.
    tp, fp, pos, neg = (F.col(c).cast("decimal(18,0)") for c in ("tp", "fp", "pos", "neg"))
    height = tp * neg - fp * pos
    best_ks = F.max(F.struct(height.alias("height"), "fp", "tp", _fpr().alias("fpr"), _tpr().alias("tpr")))
    end = F.struct(F.lit(0.0).alias("ks"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    found = curve.groupBy(*keys).agg(
        F.max("pos").alias("positives"),
        F.max("neg").alias("negatives"),
        F.sum(roc_area).alias("roc_area"),
        F.sum(pr_area).alias("auprc"),
        best_f1.alias("best_f1"),
        best_ks.alias("best_ks"),
    )
    inner = F.struct(
        (F.col("best_ks.tpr") - F.col("best_ks.fpr")).alias("ks"), F.col("best_ks.fpr"), F.col("best_ks.tpr")
    )
    ks = F.greatest(inner, end)
    whole = 2.0 * F.col("positives").cast("double") * F.col("negatives").cast("double")
    auc = F.when(F.col("positives") > 0, F.try_divide(F.col("roc_area").cast("double"), whole)).otherwise(0.0)
    return found.where("positives + negatives > 0").select(
        *keys,
        "positives",
        "negatives",
        F.when(F.col("negatives") == 0, 1.0).otherwise(auc).alias("auc"),
        F.least("auprc", F.lit(1.0)).alias("auprc"),
        (-F.col("best_f1.negated")).alias("f1_threshold"),
        F.col("best_f1.f1").alias("max_f1"),
        ks["fpr"].alias("ks_fpr"),
        ks["tpr"].alias("ks_tpr"),
        ks["ks"].alias("max_ks"),
    )


def binary_metrics(
    df: DataFrame,
    score: str = "score",
    y: str = "y",
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Counts, curve and summary in one call."""
    return binary_summary(threshold_curve(binary_counts(df, score, y, keys), keys, rows_per_slice), keys)


def roc_extract(curve: DataFrame, points: int = 1000, mode: str = "first") -> DataFrame:
    """A bounded part of an unkeyed ROC curve for display.

    ``first`` keeps the first ``points`` points from (0, 0) on. ``even`` keeps about that
    many spread over all thresholds, and both end points.
    """
    if mode == "first":
        return roc_points(curve).orderBy(F.desc("threshold"), "fpr", "tpr").limit(points)
    if mode != "even":
        raise ValueError("mode is 'first' or 'even'")
    ranked = running(
        roc_points(curve).withColumn("one", F.lit(1)),
        order="threshold",
        values=[Running("rank", "one", "sum"), Running("size", "one", "total")],
        descending=True,
    )
    step = F.greatest(F.lit(1.0), (F.col("size") - 1) / F.lit(float(max(points - 1, 1))))
    starts_step = F.floor((F.col("rank") - 1) / step) > F.floor((F.col("rank") - 2) / step)
    keep = (F.col("rank") == 1) | (F.col("rank") == F.col("size")) | starts_step
    return ranked.where(keep).select("threshold", "fpr", "tpr")
