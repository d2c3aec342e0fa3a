"""Silhouettes against all pairs and Spark's evaluator."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import plumbscore.operators.clustering as clustering
import plumbscore.operators.joins as joins
from plumbscore.operators.clustering import nearest_centre, silhouette, vector_columns, vector_silhouette
from plumbscore.session import materialize


def by_pairs(rows):
    """Mean silhouette of (cluster, point) rows."""
    clusters = {c for c, _ in rows}
    if len(clusters) < 2:
        return None

    def mean(point, members, without):
        return sum(sum((a - b) ** 2 for a, b in zip(point, m)) for m in members) / (len(members) - without)

    groups = {c: [p for k, p in rows if k == c] for c in clusters}
    scores = []
    for c, point in rows:
        if len(groups[c]) == 1:
            scores.append(0.0)
            continue
        a = mean(point, groups[c], 1)
        b = min(mean(point, groups[o], 0) for o in clusters if o != c)
        scores.append(1 - a / b if a < b else b / a - 1 if a > b else 0.0)
    return sum(scores) / len(scores)


def keyed_rows():
    rng = random.Random(8)
    rows = [("many", rng.randint(0, 3), rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(150)]
    rows += [("single", 0, 1.0, 2.0), ("single", 1, 3.0, 4.0), ("single", 1, 3.5, 4.5)]
    rows += [("one cluster", 2, 1.0, 1.0), ("one cluster", 2, 2.0, 2.0)]
    rows += [("same point", 0, 1.0, 1.0), ("same point", 0, 1.0, 1.0), ("same point", 1, 1.0, 1.0)]
    return rows + [(None, i % 2, float(i), float(i * i)) for i in range(6)]


@pytest.mark.parametrize("unrolled_terms", [128, 2])
def test_keyed(spark, monkeypatch, unrolled_terms):
    monkeypatch.setattr(clustering, "UNROLLED_TERMS", unrolled_terms)
    rows = keyed_rows()
    df = spark.createDataFrame(rows, "k string, prediction int, x double, y double").repartition(4)
    got = {r.k: r for r in silhouette(df, ["x", "y"], keys=["k"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, row in got.items():
        mine = [(c, (x, y)) for k, c, x, y in rows if k == key]
        assert row.rows == len(mine) and row.clusters == len({c for c, _ in mine})
        wanted = by_pairs(mine)
        assert row.silhouette == (None if wanted is None else pytest.approx(wanted, abs=1e-9))


def test_whole_table(spark):
    rows = [(c, x, y) for k, c, x, y in keyed_rows() if k == "many"]
    df = spark.createDataFrame(rows, "prediction int, x double, y double")
    got = silhouette(df, ["x", "y"]).first()
    assert got.silhouette == pytest.approx(by_pairs([(c, (x, y)) for c, x, y in rows]), abs=1e-9)


def test_wide_arrays_agree_with_the_evaluator(spark, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("one", F.lit(1))
    vectors = df.select(array_to_vector("embedding").alias("features"), F.col("label").alias("prediction"))
    theirs = ClusteringEvaluator().evaluate(vectors)
    assert vector_silhouette(vectors).first().silhouette == theirs
    mine = silhouette(df, vector_columns("embedding", 64), "label", ["one"]).first()
    assert mine.silhouette == pytest.approx(theirs, abs=1e-9)


def test_one_cluster(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "prediction int, x double")
    assert silhouette(df, ["x"]).first().silhouette is None


def test_nearest_centre(spark):
    df = spark.createDataFrame([(0.0, 0.0), (9.0, 9.0), (5.0, 5.0)], "x double, y double")
    found = df.select(nearest_centre(["x", "y"], [[0, 0], [10, 10], [10, 10]]).alias("c")).collect()
    assert [r.c for r in found] == [0, 1, 0]
    assert df.select(nearest_centre(["x"], [[1]]).alias("c")).distinct().collect()[0].c == 0


@pytest.mark.parametrize("clusters", [3, 130])
def test_rows_without_a_cluster_are_left_out(spark, clusters):
    rows = [("k", i % clusters, float(i), float(i * i % 17)) for i in range(300)]
    holes = [("k", None, 5.0, 5.0), ("k", None, 1.0, 2.0)]
    schema = "key string, prediction int, a double, b double"
    whole, holed = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + holes, schema)
    for keys in (("key",), ()):
        wanted, found = (silhouette(t, ["a", "b"], keys=keys).first() for t in (whole, holed))
        assert found.asDict() == pytest.approx(wanted.asDict()) if not keys else found.rows == wanted.rows == 300
        assert found.silhouette == pytest.approx(wanted.silhouette)
    assert clustering.unclustered(holed).first().unclustered == 2


def test_more_clusters_than_fit_the_driver(spark, monkeypatch):
    rows = [(i % 40, float(i % 40) * 10 + (i % 7), float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "prediction int, x double, y double")
    wanted = silhouette(df, ["x", "y"]).first()
    monkeypatch.setattr(clustering, "PACKED_BYTES", 100)
    monkeypatch.setattr(clustering, "ClusteringEvaluator", None)
    found = silhouette(df, ["x", "y"]).first()
    assert (found.rows, found.clusters) == (wanted.rows, wanted.clusters) == (400, 40)
    assert found.silhouette == pytest.approx(wanted.silhouette, abs=1e-9)


def by_sums(rows):
    """Mean silhouette of (cluster, point) arrays, every row against the sums of every cluster."""
    clusters, points = rows
    names, at = np.unique(clusters, return_inverse=True)
    n = np.bincount(at).astype(float)
    s = np.stack([np.bincount(at, weights=points[:, i]) for i in range(points.shape[1])], axis=1)
    norms = (points**2).sum(axis=1)
    q = np.bincount(at, weights=norms)
    scores = [np.zeros(int((n[at] == 1).sum()))]
    several = np.flatnonzero(n[at] > 1)
    for part in np.array_split(several, len(several) // 500 + 1):
        d = norms[part, None] + (q - 2 * points[part] @ s.T) / n
        mine = np.arange(len(d)), at[part]
        own = n[at[part]]
        a = d[mine] * own / (own - 1)
        d[mine] = np.inf
        b = d.min(axis=1)
        scores.append(np.where(a < b, 1 - a / b, np.where(a > b, b / a - 1, 0.0)))
    return float(np.concatenate(scores).mean()), len(names)


@pytest.mark.parametrize("shift", [0.0, 1000.0])
def test_blocks_of_clusters_meet_every_nearest_one(spark, monkeypatch, shift):
    monkeypatch.setattr(clustering, "PACKED_BYTES", 1000)
    monkeypatch.setattr(clustering, "BLOCK_CLUSTERS", 8)
    monkeypatch.setattr(joins, "SLICE_ROWS", 20)
    rng = np.random.default_rng(4)
    cluster = np.concatenate([rng.integers(0, 300, 2000), np.full(1000, 7), np.arange(300, 320)])
    middle = rng.normal(shift, 5, (320, 3))
    middle[100:160] = middle[100]
    points = middle[cluster] + rng.normal(0, 1, (len(cluster), 3))
    rows = [(None if k else "k", int(c), *map(float, p)) for k in (0, 1) for c, p in zip(cluster, points)]
    rows += [("one", 5, 1.0, 2.0, 3.0), ("one", 5, 2.0, 2.0, 3.0), ("two", 1, 0.0, 0.0, 0.0), ("two", 2, 1.0, 0.0, 0.0), ("two", 2, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, prediction int, x double, y double, z double").repartition(3)
    found = {r.key: r for r in silhouette(df, ["x", "y", "z"], keys=["key"]).collect()}
    wanted, clusters = by_sums((cluster, points))
    assert set(found) == {"k", None, "one", "two"}
    for key in ("k", None):
        assert (found[key].rows, found[key].clusters) == (len(cluster), clusters)
        assert found[key].silhouette == pytest.approx(wanted, abs=1e-7)
    assert found["one"].silhouette is None and found["one"].rows == 2
    assert found["two"].silhouette == pytest.approx(by_pairs([(r[1], r[2:]) for r in rows if r[0] == "two"]))
    # The same where boxes are too large to be sent to every task.
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    again = {r.key: r.silhouette for r in silhouette(df, ["x", "y", "z"], keys=["key"]).collect()}
    assert again["k"] == pytest.approx(wanted, abs=1e-7)


def test_rows_meet_few_of_some_thousand_clusters(spark, monkeypatch):
    cell = F.col("x").cast("int") * 100 + F.col("y").cast("int")
    spots = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(size * 1000)) / 1000).alias(name) for i, (name, size) in enumerate({"x": 50, "y": 100}.items())]
    rows = spark.range(20_000).select(*spots).withColumn("prediction", cell)
    written = {}

    def kept(df, name="table", by=()):
        written[name] = materialize(df, name, by)
        return written[name]

    monkeypatch.setattr(clustering, "materialize", kept)
    got = silhouette(rows, ["x", "y"]).first()
    sizes = written["cluster-near"].groupBy("block").agg(F.count("*").alias("clusters"))
    pairs = written["cluster-reached"].join(sizes, "block").agg(F.sum("clusters")).first()[0]
    assert pairs < 200 * got.rows
    local = rows.toPandas()
    wanted, clusters = by_sums((local["prediction"].to_numpy(), local[["x", "y"]].to_numpy()))
    assert (got.rows, got.clusters) == (20_000, clusters) and clusters > 4000
    assert got.silhouette == pytest.approx(wanted, abs=1e-7)


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 1e200])
def test_odd_numbers_rule_no_block_out(spark, monkeypatch, odd):
    monkeypatch.setattr(clustering, "PACKED_BYTES", 1000)
    monkeypatch.setattr(clustering, "BLOCK_CLUSTERS", 8)
    rows = [(i % 60, float(i % 60) * 10 + i % 7, float(i % 3)) for i in range(600)] + [(60, odd, 0.0), (60, odd, 1.0), (61, 0.0, odd)]
    df = spark.createDataFrame(rows, "prediction int, x double, y double").withColumn("key", F.lit(1))
    found = silhouette(df, ["x", "y"], keys=["key"]).first()
    plain = spark.createDataFrame(rows[:600], "prediction int, x double, y double").withColumn("key", F.lit(1))
    assert (found.rows, found.clusters) == (603, 62)
    assert silhouette(plain, ["x", "y"], keys=["key"]).first().silhouette == pytest.approx(by_pairs([(r[0], r[1:]) for r in rows[:600]]), abs=1e-9)


def test_a_hundred_thousand_clusters(spark, monkeypatch):
    number = F.col("id") % 100_000
    hashed = [F.pmod(F.xxhash64(number, F.lit(i)), F.lit(1000)) + F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 100 for i in (0, 1)]
    rows = spark.range(103_000).select(number.alias("prediction"), hashed[0].alias("x"), hashed[1].alias("y"))
    written = {}

    def kept(df, name="table", by=()):
        written[name] = materialize(df, name, by)
        return written[name]

    monkeypatch.setattr(clustering, "materialize", kept)
    got = silhouette(rows, ["x", "y"]).first()
    # Rows meet few of the hundreds of blocks, and no block is large.
    assert written["cluster-reached"].count() < 3 * got.rows
    assert written["cluster-near"].groupBy("block").count().agg(F.max("count")).first()[0] < 1000
    local = rows.toPandas()
    wanted, clusters = by_sums((local["prediction"].to_numpy(), local[["x", "y"]].to_numpy()))
    assert (got.rows, got.clusters) == (103_000, clusters) == (103_000, 100_000)
    assert got.silhouette == pytest.approx(wanted, abs=1e-7)
