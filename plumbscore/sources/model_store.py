"""Saving, loading and listing fitted pipelines."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.functions import split_text

FEATURE_PIPELINE_FOLDER = "transform"
MODEL_FOLDER = "models"
PROFILE_FOLDER = "profiles"


def model_path(data_dir: str, name: str) -> str:
    """Where the model called ``name`` is kept below a data folder."""
    return os.path.join(data_dir, MODEL_FOLDER, name)


def feature_pipeline_path(data_dir: str) -> str:
    """Where the fitted assembler and indexer are kept below a data folder."""
    return os.path.join(data_dir, FEATURE_PIPELINE_FOLDER)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a pipeline, replacing an older one; an empty path saves nothing."""
    if path:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Read a pipeline back."""
    return PipelineModel.load(path)


def profile_path(data_dir: str, name: str) -> str:
    """Where the sketches of the training inputs of the model called ``name`` are kept."""
    return os.path.join(data_dir, PROFILE_FOLDER, name)


def save_profile(sketches: DataFrame, path: str) -> None:
    """Write the input sketches of a model's training rows, one row per feature, replacing older ones."""
    sketches.coalesce(1).write.mode("overwrite").parquet(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """Read the input sketches back."""
    return spark.read.parquet(path)


def registry(spark: SparkSession, models_dir: str) -> DataFrame:
    """``(model, stage, class, uid, params)`` for every stage of every saved model.

    Parameters are kept as JSON text, because their types differ between stages.
    """
    found = spark.read.text(os.path.join(models_dir, "*", "stages", "*", "metadata", "part-*"))
    folders = F.split(F.input_file_name(), "/")

    def folder(from_end: int) -> Column:
        return F.element_at(folders, -from_end)

    return found.select(
        F.url_decode(F.replace(folder(5), F.lit("+"), F.lit("%2B"))).alias("model"),
        F.element_at(F.split(folder(3), "_"), 1).cast("int").alias("stage"),
        F.get_json_object("value", "$.class").alias("class"),
        F.get_json_object("value", "$.uid").alias("uid"),
        F.get_json_object("value", "$.paramMap").alias("params"),
    )


def model_names(listing: DataFrame) -> DataFrame:
    """Distinct names in a registry."""
    return listing.select("model").distinct()


def select_models(listing: DataFrame, names: str) -> DataFrame:
    """The registry rows of a comma-separated list of names."""
    chosen = [n.strip() for n in names.split(",") if n.strip()]
    return listing.where(F.col("model").isin(chosen))


def select_by_requests(listing: DataFrame, requests: DataFrame, column: str) -> DataFrame:
    """The registry rows named in a table of comma-separated selections."""
    wanted = requests.select(F.explode(split_text(column)).alias("model")).distinct()
    return listing.join(wanted, "model", "left_semi")
