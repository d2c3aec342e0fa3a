"""Curves against plain loops and Spark's own metrics."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.mllib.evaluation import BinaryClassificationMetrics

from plumbscore.operators.curves import (
    binary_counts,
    binary_metrics,
    binary_summary,
    f_points,
    ks_points,
    pr_points,
    roc_extract,
    roc_points,
    score_pairs,
    threshold_curve,
    unscored,
)


def plain(pairs):
    """The summary of a list of (score, y) by counting at every threshold."""
    pos, neg = sum(y > 0.5 for _, y in pairs), sum(y <= 0.5 for _, y in pairs)
    roc, pr, best_f1, best_ks = [(0.0, 0.0)], [], None, (0.0, 1.0, 1.0)
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(s >= t and y > 0.5 for s, y in pairs)
        fp = sum(s >= t and y <= 0.5 for s, y in pairs)
        tpr, fpr = tp / pos if pos else 0.0, fp / neg if neg else 0.0
        precision = tp / (tp + fp)
        f1 = 2 * precision * tpr / (precision + tpr) if precision + tpr else 0.0
        if not pr:
            pr.append((0.0, precision))
        pr.append((tpr, precision))
        roc.append((fpr, tpr))
        best_f1 = max(best_f1 or (f1, -t), (f1, -t))
        best_ks = max(best_ks, (tpr - fpr, fpr, tpr))
    roc.append((1.0, 1.0))

    def area(points):
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

    return {
        "positives": pos,
        "negatives": neg,
        "auc": area(roc),
        "auprc": area(pr),
        "max_f1": best_f1[0],
        "f1_threshold": -best_f1[1],
        "max_ks": best_ks[0],
        "ks_fpr": best_ks[1],
        "ks_tpr": best_ks[2],
    }


def table(spark, pairs):
    return spark.createDataFrame(pairs, "score double, y double")


CASES = {
    "ties": [(random.Random(1).randint(0, 9) / 8, float(i % 3 == 0)) for i in range(50)],
    "random": [(r.random(), float(r.random() < 0.3)) for r in [random.Random(2)] for _ in range(300)],
    "good": [(r.random() + (i % 2), float(i % 2)) for r in [random.Random(3)] for i in range(100)],
    "bad": [(r.random() - (i % 2), float(i % 2)) for r in [random.Random(4)] for i in range(100)],
    "negative scores": [(r.gauss(0, 50), float(r.random() < 0.5)) for r in [random.Random(5)] for _ in range(200)],
    "all positive": [(0.1 * i, 1.0) for i in range(10)],
    "all negative": [(0.1 * i, 0.0) for i in range(10)],
    "all tied": [(0.5, float(i % 2)) for i in range(10)],
    "one row": [(0.7, 1.0)],
    "zero": [(0.0, 0.0), (0.0, 1.0), (-0.0, 1.0)],
}


@pytest.mark.parametrize("rows_per_slice", [3, 100_000])
@pytest.mark.parametrize("case", CASES)
def test_summary(spark, case, rows_per_slice):
    got = binary_metrics(table(spark, CASES[case]), rows_per_slice=rows_per_slice).collect()
    assert len(got) == 1
    assert got[0].asDict() == pytest.approx(plain(CASES[case]), abs=1e-12)


@pytest.mark.parametrize("case", ["ties", "random", "good", "all positive", "all negative"])
def test_areas_agree_with_spark(spark, case):
    pairs = CASES[case]
    theirs = BinaryClassificationMetrics(spark.sparkContext.parallelize(pairs, 3))
    got = binary_metrics(table(spark, pairs)).first()
    assert got.auc == pytest.approx(theirs.areaUnderROC, abs=1e-12)
    assert got.auprc == pytest.approx(theirs.areaUnderPR, abs=1e-12)


@pytest.mark.parametrize("rows_per_slice", [20, 100_000])
def test_keys_with_a_hot_one_and_null(spark, rows_per_slice):
    rng = random.Random(6)
    rows = [
        (rng.choices(["hot", None, "x", "y"], [6, 2, 1, 1])[0], rng.randint(0, 99) / 100, float(rng.random() < 0.4))
        for _ in range(800)
    ]
    df = spark.createDataFrame(rows, "k string, score double, y double")
    got = {r.k: r.asDict() for r in binary_metrics(df, keys=["k"], rows_per_slice=rows_per_slice).collect()}
    assert set(got) == {"hot", None, "x", "y"}
    for key in got:
        found = {n: v for n, v in got[key].items() if n != "k"}
        assert found == pytest.approx(plain([(s, y) for k, s, y in rows if k == key]), abs=1e-12)


def test_empty(spark):
    assert binary_metrics(table(spark, [])).collect() == []
    assert roc_points(threshold_curve(binary_counts(table(spark, [])))).collect() == []


def test_rows_without_score_or_label(spark):
    df = table(spark, [(0.5, 1.0), (None, 1.0), (0.2, None), (0.1, 0.0)])
    got = binary_metrics(df).first()
    assert (got.positives, got.negatives) == (1, 1)
    assert unscored(df).first()["unscored"] == 2


def test_flipping_both_sides_keeps_the_area(spark):
    pairs = CASES["ties"]
    flipped = [(1 - s, 1 - y) for s, y in pairs]
    assert binary_metrics(table(spark, pairs)).first().auc == pytest.approx(
        binary_metrics(table(spark, flipped)).first().auc, abs=1e-12
    )


def test_curves_are_monotone_and_complete(spark):
    curve = threshold_curve(binary_counts(table(spark, CASES["random"])), rows_per_slice=20)
    roc = roc_points(curve).orderBy("threshold", ascending=False).collect()
    assert (roc[0].fpr, roc[0].tpr, roc[-1].fpr, roc[-1].tpr) == (0, 0, 1, 1)
    assert len(roc) == len({s for s, _ in CASES["random"]}) + 2
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(roc, roc[1:]))
    pr = pr_points(curve).orderBy("threshold", ascending=False).collect()
    assert pr[0].recall == 0 and pr[0].precision == pr[1].precision and pr[-1].recall == 1
    assert ks_points(curve).count() == len(roc)
    assert all(0 <= r.f <= 1 for r in f_points(curve, beta=2.0).collect())


def test_counts_add_up(spark):
    pairs = CASES["ties"]
    halves = [binary_counts(table(spark, part)) for part in (pairs[:20], pairs[20:])]
    summed = halves[0].unionByName(halves[1]).groupBy("score").sum("p", "n")
    summed = summed.toDF("score", "p", "n")
    assert binary_summary(threshold_curve(summed)).first().asDict() == pytest.approx(plain(pairs), abs=1e-12)


def test_one_class_against_the_rest(spark):
    scored = spark.createDataFrame(
        [(Vectors.dense(0.7, 0.2, 0.1), 0.0), (Vectors.sparse(3, {1: 1.0}), 1.0), (Vectors.dense(0.3, 0.3, 0.4), 2.0)],
        ["probability", "label"],
    )
    assert [(r.score, r.y) for r in score_pairs(scored).collect()] == [(0.7, 1.0), (0.0, 0.0), (0.3, 0.0)]
    assert [(r.score, r.y) for r in score_pairs(scored, positive_label=2).collect()] == [(0.1, 0), (0.0, 0), (0.4, 1)]


def test_extracts(spark):
    curve = threshold_curve(binary_counts(table(spark, CASES["random"])))
    first = roc_extract(curve, 10).collect()
    assert len(first) == 10 and first[0].threshold == float("inf")
    even = roc_extract(curve, 11, "even").orderBy("threshold", ascending=False).collect()
    assert (even[0].fpr, even[-1].tpr) == (0, 1) and 11 <= len(even) <= 12
    assert roc_extract(curve, 10_000, "even").count() == 302
    with pytest.raises(ValueError):
        roc_extract(curve, 5, "odd")


def test_gaps_are_left_out_and_counted(spark):
    nan = float("nan")
    rows = [(0.9, 1.0), (0.4, 0.0), (0.7, 1.0), (nan, 0.0), (0.8, nan), (None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "score double, y double")
    found = binary_metrics(df).first()
    assert (found.positives, found.negatives, found.auc) == (2, 1, 1.0)
    assert unscored(df).first().unscored == 4
    scored = spark.createDataFrame([(1.0, [0.7, 0.3]), (None, [0.2, 0.8])], "label double, p array<double>")
    pairs = score_pairs(scored.withColumn("probability", array_to_vector("p")), positive_label=1)
    assert [(r.score, r.y) for r in pairs.collect()] == [(0.3, 1.0), (0.8, None)]


def test_ks_ties_are_exact_on_billions(spark):
    big = 3_000_000_000
    # Equal distances at the first and second step; the point furthest along the curve counts.
    rows = [(0.9, big // 3, 0), (0.8, 1, 1), (0.7, big - big // 3 - 1, big - 1)]
    counts = spark.createDataFrame(rows, "score double, p long, n long")
    found = binary_summary(threshold_curve(counts)).first()
    assert found.ks_fpr == 1 / big and found.ks_tpr == (big // 3 + 1) / big
