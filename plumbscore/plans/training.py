"""Fitting, scoring and evaluating the four supported models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbscore.functions import result_json
from plumbscore.operators.clustering import vector_silhouette
from plumbscore.operators.curves import binary_counts, binary_summary, roc_extract, score_pairs, threshold_curve
from plumbscore.operators.features import (
    Prepared,
    check_features,
    feature_columns,
    filled,
    prepare,
    random_split,
    split_part,
)
from plumbscore.session import materialize
from plumbscore.sources.model_store import feature_pipeline_path, model_path, save_model

# Model names and their default parameters.
CLASSIFIERS = ("logisticRegression", "randomForest", "neuralNetwork")
CLUSTERERS = ("kmeans",)
DEFAULTS: dict[str, dict[str, Any]] = {
    "logisticRegression": {"maxIter": 10, "regParam": 0.01},
    "randomForest": {"maxBins": 500, "numTrees": 100},
    "kmeans": {"k": 5},
    "neuralNetwork": {"blockSize": 128, "maxIter": 100},
}
HIDDEN_LAYERS = (3, 3)
SCALED = "scaledFeatures"
PART = "__part"


def class_count(df: DataFrame, label: str = "label") -> int:
    """Number of classes, from the indexer's metadata when it is there."""
    values = df.schema[label].metadata.get("ml_attr", {}).get("vals")
    if values is not None:
        return len(values)
    highest = df.agg(F.max(label).alias("highest")).first()["highest"]
    return int(highest or 0) + 1


def vector_size(df: DataFrame, features: str = "features") -> int:
    """Width of the feature vector, from the assembler's metadata when it is there."""
    size = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if size is not None:
        return int(size)
    return int(df.select(F.size(vector_to_array(features)).alias("size")).first()["size"])


def estimator(name: str, train: DataFrame, label: str = "label", **params: Any) -> Estimator:
    """An unfitted model with the default parameters, changed by ``params``."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}, expected one of {tuple(DEFAULTS)}")
    chosen = {**DEFAULTS[name], **params}
    if name == "logisticRegression":
        return LogisticRegression(featuresCol="features", labelCol=label, **chosen)
    if name == "randomForest":
        return RandomForestClassifier(featuresCol="features", labelCol=label, **chosen)
    if name == "kmeans":
        return KMeans(featuresCol="features", predictionCol="prediction", **chosen)
    layers = chosen.pop("layers", None) or [vector_size(train), *HIDDEN_LAYERS, max(2, class_count(train, label))]
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=layers, **chosen)


def fit(
    name: str, train: DataFrame, label: str = "label", columns: Sequence[str] | None = None, **params: Any
) -> PipelineModel:
    """Fit one model.

    With ``columns`` the pipeline starts with its own assembler and can score raw tables;
    otherwise ``train`` already has ``features``. A neural network is fitted on standardized
    features, which the pipeline derives itself.
    """
    stages = [] if columns is None else [VectorAssembler(inputCols=list(columns), outputCol="features")]
    assembled = PipelineModel(stages).transform(train)
    model = estimator(name, assembled, label, **params)
    if name == "neuralNetwork":
        # Its solver reads all rows at every step, and needs far fewer steps on features of one size.
        scaler = StandardScaler(inputCol="features", outputCol=SCALED, withMean=True).fit(assembled)
        stages.append(scaler)
        assembled = scaler.transform(assembled)
        model.setFeaturesCol(SCALED)
    return PipelineModel([*stages, model.fit(assembled)])


def score(
    model: PipelineModel, df: DataFrame, output: str | None = None, positive_label: int = 0
) -> DataFrame:
    """Apply a model.

    Without ``output`` the model's own columns are added. With it only one column is added:
    the probability of ``positive_label``, or the cluster of a clustering model. So several
    models can score one table in one pass.
    """
    scored = model.transform(df)
    if output is None:
        return scored
    value = (
        vector_to_array("probability")[positive_label]
        if "probability" in scored.columns
        else F.col("prediction").cast("double")
    )
    return scored.select(*df.columns, value.alias(output))


def score_all(models: Mapping[str, PipelineModel], df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """All models on every row, in long form ``(kept columns, model, score)``."""
    scored = df
    outputs = {name: f"__score_{name}" for name in models}
    for name, model in models.items():
        scored = score(model, scored, outputs[name])
    pairs = [F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in outputs.items()]
    kept = list(keep) if keep is not None else df.columns
    return scored.select(*kept, F.explode(F.array(*pairs)).alias("__scored")).select(*kept, "__scored.*")


def fit_score(name: str, train: DataFrame, test: DataFrame, label: str = "label", **params: Any) -> DataFrame:
    """Fit on one table, apply to another."""
    return score(fit(name, train, label, **params), test)


def coefficients(model: PipelineModel, features: Sequence[str]) -> list[tuple[int, str, float]]:
    """``(class, feature, weight)`` of a logistic regression, with the feature ``Intercept``.

    A two-class model has one set of weights, for class 1. The list is as long as the model,
    which lives on the driver anyway.
    """
    found = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    matrix = found.coefficientMatrix.toArray()
    intercepts = found.interceptVector.toArray()
    classes = [1] if len(matrix) == 1 else range(len(matrix))
    rows = []
    for position, label in enumerate(classes):
        rows.append((label, "Intercept", float(intercepts[position])))
        rows.extend((label, name, float(weight)) for name, weight in zip(features, matrix[position]))
    return rows


def coefficient_table(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """:func:`coefficients` as a table of the session of ``df``."""
    return df.sparkSession.createDataFrame(coefficients(model, features), "class int, feature string, weight double")


def coefficient_map(weights: Mapping[str, float]) -> Column:
    """Feature names and weights as a map column."""
    return F.create_map(*[F.lit(part) for pair in weights.items() for part in pair])


def prepare_parts(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
    weights: Sequence[float] = (0.8, 0.2),
    salt: str = "split",
    index: bool = True,
) -> tuple[Prepared, list[DataFrame]]:
    """:func:`prepare`, and its data split by a hash of ``key``, or of all columns without one.

    The features and the target are written once, as plain columns beside the number of the part: counting labels,
    each pass of a fit and the scores read them from there, and none of them derives ``df`` again.
    """
    features = feature_columns(df, target, columns)
    check_features(df, features)
    part = split_part(key or df.columns, weights, salt).alias(PART)
    written = materialize(filled(df, features).select(*dict.fromkeys([*features, target]), part), "split")
    prepared = prepare(written, target, features, index)
    kept = ["features", "label"] if index else ["features"]
    # Spark leaves a filter above the functions that make vectors, so each part is taken before.
    known = written.where(F.col(target).isNotNull())
    rows = [known.where(F.col(PART) == number) for number in range(len(weights))]
    return prepared, [prepared.model.transform(part_rows).select(*kept) for part_rows in rows]


def train_evaluate(
    df: DataFrame,
    target: str,
    name: str,
    columns: Sequence[str] | None = None,
    key: str | Sequence[str] | None = None,
    weights: Sequence[float] = (0.8, 0.2),
    seed: int | None = None,
    random: bool = False,
    split_salt: str | None = None,
    data_dir: str = "",
    positive_label: int = 0,
    roc_size: int = 1000,
    roc_mode: str = "even",
    **params: Any,
) -> DataFrame:
    """Split, fit, save, score and measure; one row with the result.

    Rows are split by a hash of ``key``, or of all columns without one, salted by the seed
    unless ``split_salt`` is given; ``random=True`` takes Spark's own split. Models go below
    ``data_dir``, nothing is saved without it. The result holds about ``roc_size`` points of the
    ROC: spread over all thresholds with both ends, or the first ones if ``roc_mode`` is ``first``.
    Rows without a target are left out and counted in ``rowsWithoutTarget``. A clustering needs
    no label, so its target may have any number of values.
    """
    index = name not in CLUSTERERS
    # Iterative fits read their input several times: write it once instead.
    if random:
        prepared = prepare(df, target, columns, index)
        train, test = random_split(prepared.data, weights, seed)
        train = materialize(train.select(*(["features", "label"] if index else ["features"])), "train")
    else:
        salt = split_salt or ("split" if seed is None else f"split-{seed}")
        prepared, (train, test) = prepare_parts(df, target, columns, key, weights, salt, index)
    if seed is not None and name != "logisticRegression":
        params = {"seed": seed, **params}
    model = fit(name, train, **params)
    if data_dir:
        save_model(prepared.model, feature_pipeline_path(data_dir))
        save_model(model, model_path(data_dir, name))
    scored = score(model, test)
    if name in CLUSTERERS:
        clustered = materialize(scored.select("features", "prediction"), "clustered")
        return vector_silhouette(clustered).select(F.lit(name).alias("estimator"), "rows", "clusters", "silhouette")

    # Filters on a score repeat the model's functions: write the scores once instead.
    pairs = materialize(score_pairs(scored, positive_label=positive_label), "pairs")
    curve = threshold_curve(binary_counts(pairs))
    points = roc_extract(curve, roc_size, roc_mode).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("threshold")).alias("order"), "fpr", "tpr"))).alias("points")
    )
    result = binary_summary(curve).select(
        F.lit(name).alias("estimator"),
        "positives",
        "negatives",
        F.col("auc").alias("areaUnderROC"),
        "auprc",
        F.struct(F.col("f1_threshold").alias("threshold"), F.col("max_f1").alias("f1")).alias("maxF1"),
        F.struct(F.col("ks_fpr").alias("fpr"), F.col("ks_tpr").alias("tpr"), F.col("max_ks").alias("ks")).alias("maxKS"),
        points.select(F.transform("points", lambda p: F.struct(p["fpr"].alias("fpr"), p["tpr"].alias("tpr"))))
        .scalar()
        .alias("roc"),
        prepared.rows_without_target.scalar().alias("rowsWithoutTarget"),
    )
    if name == "logisticRegression":
        weights_by_feature = {
            feature if label == 1 and len(prepared.labels) == 2 else f"{label}:{feature}": weight
            for label, feature, weight in coefficients(model, prepared.features)
        }
        result = result.withColumn("coefficients", coefficient_map(weights_by_feature))
    return result


def as_json(result: DataFrame) -> DataFrame:
    """A result table as one JSON text per row."""
    return result.select(result_json(result.columns).alias("json"))
