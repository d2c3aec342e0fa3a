"""Fitting, scoring, saving and whole training jobs."""

from __future__ import annotations

import json

import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from plumbscore.operators.features import hash_split, prepare
from plumbscore.plans.training import (
    CLASSIFIERS,
    as_json,
    coefficient_table,
    coefficients,
    estimator,
    fit,
    fit_score,
    prepare_parts,
    score,
    score_all,
    train_evaluate,
)
from plumbscore.session import scratch_path
from plumbscore.sources.model_store import (
    feature_pipeline_path,
    load_model,
    model_names,
    model_path,
    registry,
    save_model,
    select_models,
)


@pytest.fixture(scope="module")
def points(spark):
    """300 rows of three classes by one feature, and some noise."""
    return spark.range(300).select(
        "id",
        (F.col("id") % 100).cast("double").alias("x"),
        F.when(F.col("id") % 7 != 0, F.rand(3)).alias("noise"),
        F.when(F.col("id") % 100 < 50, "low").when(F.col("id") % 100 < 80, "mid").otherwise("high").alias("three"),
        F.when(F.col("id") % 100 < 60, "no").otherwise("yes").alias("two"),
    )


def test_default_parameters(spark, points):
    data = prepare(points, "three", ["x", "noise"]).data
    forest = estimator("randomForest", data)
    assert isinstance(forest, RandomForestClassifier) and forest.getNumTrees() == 100 and forest.getMaxBins() == 500
    network = estimator("neuralNetwork", data)
    assert isinstance(network, MultilayerPerceptronClassifier)
    assert list(network.getLayers()) == [2, 3, 3, 3] and network.getMaxIter() == 100
    assert estimator("kmeans", data).getK() == 5
    regression = estimator("logisticRegression", data, maxIter=20)
    assert regression.getRegParam() == 0.01 and regression.getMaxIter() == 20
    with pytest.raises(ValueError, match="unknown model"):
        estimator("svm", data)


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifiers_recover_a_threshold(spark, points, name):
    params = {} if name == "logisticRegression" else {"seed": 1}
    data = prepare(points, "two", ["x"]).data
    scored = fit_score(name, data, data, **params)
    assert scored.where("prediction != label").count() <= 10


def test_network_fit_does_not_depend_on_units(spark, points):
    steps, wrong = [], []
    for unit in (1, 1024):
        data = prepare(points.withColumn("x", F.col("x") * unit), "two", ["x"]).data
        model = fit("neuralNetwork", data, seed=1)
        steps.append(model.stages[-1].summary().totalIterations)
        wrong.append(score(model, data).where("prediction != label").count())
    assert steps[0] == steps[1] and steps[0] < 60
    assert wrong == [0, 0]


def test_network_fit_with_constant_feature(spark, points):
    data = prepare(points.withColumn("same", F.lit(7.0)), "two", ["x", "same"]).data
    scored = fit_score("neuralNetwork", data, data, seed=1)
    assert scored.where("prediction != label").count() <= 10


def test_coefficients(spark, points):
    two = prepare(points, "two", ["x", "noise"])
    rows = coefficients(fit("logisticRegression", two.data), two.features)
    assert [(c, f) for c, f, _ in rows] == [(1, "Intercept"), (1, "x"), (1, "noise")]
    assert rows[1][2] > 0
    three = prepare(points, "three", ["x", "noise"])
    table = coefficient_table(three.data, fit("logisticRegression", three.data), three.features)
    assert table.count() == 9 and {r["class"] for r in table.collect()} == {0, 1, 2}


def test_saved_models_score_alike(spark, points):
    raw = points.withColumn("label", (F.col("two") == "yes").cast("double")).na.fill(0)
    root = scratch_path(spark, "test-models")
    models = {
        "randomForest": fit("randomForest", raw, columns=["x", "noise"], seed=2, numTrees=5),
        "logisticRegression": fit("logisticRegression", raw, columns=["x", "noise"]),
        "kmeans": fit("kmeans", raw, columns=["x", "noise"], seed=2, k=2),
    }
    for name, model in models.items():
        save_model(model, model_path(root, name))
        save_model(model, model_path(root, name))
    save_model(models["kmeans"], "")
    loaded = {name: load_model(model_path(root, name)) for name in models}
    before, after = (
        sorted((r.id, r.model, r.score) for r in score_all(m, raw, ["id"]).collect()) for m in (models, loaded)
    )
    assert before == after and len(before) == 900

    listing = registry(spark, model_path(root, ""))
    assert {r.model for r in model_names(listing).collect()} == set(models)
    stages = {(r.model, r.stage): r["class"].rsplit(".", 1)[1] for r in listing.collect()}
    assert len(stages) == 6
    assert stages["kmeans", 1] == "KMeansModel" and stages["randomForest", 0] == "VectorAssembler"
    forest = listing.where("model = 'randomForest' and stage = 1").first()
    assert json.loads(forest.params)["numTrees"] == 5
    assert {r.model for r in select_models(listing, "kmeans, randomForest,none").collect()} == {"kmeans", "randomForest"}


def test_models_score_one_table_in_one_pass(spark, points):
    raw = points.withColumn("label", (F.col("two") == "yes").cast("double"))
    model = fit("logisticRegression", raw, columns=["x"])
    twice = score(model, score(model, raw, "zero", 0), "one", 1)
    assert twice.columns == [*raw.columns, "zero", "one"]
    assert twice.where("abs(zero + one - 1) > 1e-9").count() == 0


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_train_evaluate(spark, points, name):
    root = scratch_path(spark, "test-job")
    result = train_evaluate(points, "two", name, ["x", "noise"], "id", seed=5, data_dir=root)
    row = result.first()
    assert row.estimator == name
    assert 20 < row.positives + row.negatives < 100
    assert row.areaUnderROC > 0.9 and 0 <= row.auprc <= 1
    assert row.maxF1.f1 > 0.8 and row.maxKS.ks == pytest.approx(row.maxKS.tpr - row.maxKS.fpr)
    assert (row.roc[0].fpr, row.roc[0].tpr, row.roc[-1].fpr, row.roc[-1].tpr) == (0, 0, 1, 1)
    if name == "logisticRegression":
        assert set(row.coefficients) == {"Intercept", "x", "noise"}
    document = json.loads(as_json(result).first().json)
    assert document["estimator"] == name and document["maxKS"]["ks"] == row.maxKS.ks
    assert load_model(model_path(root, name)).stages
    assert len(load_model(feature_pipeline_path(root)).stages) == 2


def test_train_evaluate_derives_its_input_once(spark, points):
    derived = spark.sparkContext.accumulator(0)

    def seen(value):
        derived.add(1)
        return value

    rows = points.withColumn("two", F.udf(seen)("two"))
    row = train_evaluate(rows, "two", "logisticRegression", ["x"], "id", seed=5).first()
    assert row.areaUnderROC == 1 and row.rowsWithoutTarget == 0
    assert derived.value == 300


def test_parts_are_those_of_the_hash_split(spark, points):
    rows = points.withColumn("flag", F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0)).withColumn(
        "two", F.when(F.col("id") % 10 != 0, F.col("two"))
    )
    columns = ["x", "noise", "flag", "x"]
    for key in ("id", None):
        prepared, parts = prepare_parts(rows, "two", columns, key, (0.5, 0.3, 0.2), "salt")
        plain = prepare(rows, "two", columns)
        assert prepared.labels == plain.labels and prepared.features == plain.features
        assert prepared.rows_without_target.collect() == plain.rows_without_target.collect()
        wanted = hash_split(plain.data, key or rows.columns, (0.5, 0.3, 0.2), "salt")
        for found, part in zip(parts, wanted, strict=True):
            assert found.columns == ["features", "label"]
            assert sorted(map(str, found.collect())) == sorted(map(str, part.select("features", "label").collect()))
        assert sum(part.count() for part in parts) == 270


def test_train_evaluate_three_classes(spark, points):
    row = train_evaluate(points, "three", "logisticRegression", ["x", "noise"], "id").first()
    assert row.areaUnderROC > 0.9 and len(row.coefficients) == 9
    other = train_evaluate(points, "three", "logisticRegression", ["x"], "id", positive_label=2).first()
    assert other.positives < row.positives


def test_train_evaluate_options(spark, points):
    drawn = train_evaluate(points, "two", "logisticRegression", ["x"], random=True, seed=3).first()
    assert drawn.areaUnderROC == 1
    short = train_evaluate(points, "two", "logisticRegression", ["x"], roc_size=3).first()
    assert len(short.roc) == 3


def test_train_evaluate_clusters(spark, points):
    row = train_evaluate(points, "two", "kmeans", ["x"], "id", seed=1, k=3).first()
    assert row.estimator == "kmeans" and row.clusters == 3 and 0.5 < row.silhouette < 1
    alone = train_evaluate(points.withColumn("x", F.lit(1.0)), "two", "kmeans", ["x"], "id", seed=1).first()
    assert alone.clusters == 1 and alone.silhouette is None
