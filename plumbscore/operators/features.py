"""Feature vectors, label indexes and splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbscore.functions import fill_numbers, hash_uniform, pick_by_weight
from plumbscore.operators.running import rank_rows

MAX_LABELS = 10_000


def feature_columns(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> list[str]:
    """The named columns, or all, without the target."""
    return [c for c in (columns or df.columns) if c != target]


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    """Raise unless every feature can go into a vector."""
    wrong = [
        f"{name} ({df.schema[name].dataType.simpleString()})"
        for name in features
        if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))
        and df.schema[name].dataType.typeName() not in ("vector", "vectorudt")
    ]
    if wrong:
        raise ValueError("features must be numbers; load the file with inferred types or leave out: " + ", ".join(wrong))


def _as_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Truth values as 0 and 1, so that missing ones are filled like missing numbers."""
    return df.withColumns({f: F.col(f).cast("int") for f in features if isinstance(df.schema[f].dataType, T.BooleanType)})


def filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with truth values of ``features`` as 0 and 1, and their missing numbers as 0."""
    return fill_numbers(_as_numbers(df, features), features)


@dataclass(frozen=True)
class Prepared:
    """A fitted assembler and indexer with the table they produced."""

    model: PipelineModel
    data: DataFrame
    features: list[str]
    labels: list[str]
    rows_without_target: DataFrame


def class_labels(df: DataFrame, target: str, max_labels: int = MAX_LABELS) -> list[str]:
    """The distinct targets as text, by falling frequency and then by text.

    More than ``max_labels`` raise an error: a number that varies is no class.
    """
    texts = df.select(F.col(target).cast("string").alias("value")).where("value IS NOT NULL")
    found = label_frequency(texts, "value").limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"{target} has more than {max_labels} distinct values")
    return [r["value"] for r in sorted(found, key=lambda r: (-r["n"], r["value"]))]


def prepare(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    index: bool = True,
    max_labels: int = MAX_LABELS,
) -> Prepared:
    """Add ``features`` and ``label``: missing numbers become 0, labels go by falling frequency.

    Only features are filled. Rows without a target have no label; they are left out of the
    data and counted in ``rows_without_target``. ``index=False`` adds no label, for clustering;
    otherwise more than ``max_labels`` distinct targets raise an error.
    """
    features = feature_columns(df, target, columns)
    check_features(df, features)
    missing = df.agg(F.count_if(F.col(target).isNull()).alias("rows_without_target"))
    known = filled(df.where(F.col(target).isNotNull()), features)
    labels = class_labels(known, target, max_labels) if index else []
    stages = [VectorAssembler(inputCols=features, outputCol="features")]
    if index:
        stages.append(StringIndexerModel.from_labels(labels, inputCol=target, outputCol="label"))
    model = PipelineModel(stages)
    return Prepared(model, model.transform(known), features, labels, missing)


def feature_array(df: DataFrame, features: Sequence[str], output: str = "feature_array") -> DataFrame:
    """The filled features as an array of doubles, in column order."""
    return filled(df, features).withColumn(output, F.array(*[F.col(f).cast("double") for f in features]))


def label_frequency(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value."""
    return df.groupBy(target).agg(F.count("*").alias("n"))


def label_table(df: DataFrame, target: str) -> DataFrame:
    """``(value, label, n)``: label 0 for the most frequent value, ties by text."""
    counts = label_frequency(df.where(F.col(target).isNotNull()), target)
    values = counts.select(F.col(target).cast("string").alias("value"), "n")
    ranked = rank_rows(values, [F.desc("n"), F.asc("value")])
    return ranked.select("value", (F.col("rank") - 1).cast("double").alias("label"), "n")


def split_part(key: str | Sequence[str], weights: Sequence[float] = (0.8, 0.2), salt: str = "split") -> Column:
    """Number of the part that :func:`hash_split` puts a row in."""
    keys = [key] if isinstance(key, str) else list(key)
    return pick_by_weight(hash_uniform(*keys, salt=salt), range(len(weights)), weights)


def hash_split(
    df: DataFrame, key: str | Sequence[str], weights: Sequence[float] = (0.8, 0.2), salt: str = "split"
) -> list[DataFrame]:
    """Disjoint, complete parts by the hash of ``key``; rows with one key stay together."""
    part = split_part(key, weights, salt)
    return [df.where(part == number) for number in range(len(weights))]


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int | None = None) -> list[DataFrame]:
    """Spark's own split; repeatable only while the input keeps its partitioning."""
    return df.randomSplit([float(w) for w in weights], seed)
