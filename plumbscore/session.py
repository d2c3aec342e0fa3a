"""Session helpers: building a session and cutting lineage through shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The folder that takes the scratch paths of the running block, see scratch().
_OWNER: ContextVar[str | None] = ContextVar("scratch_owner", default=None)


def build_session(app_name: str = "plumbscore", cores: int | str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC time; ``cores`` asks for local mode."""
    builder = SparkSession.builder.appName(app_name)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and derived tables, one sub-folder per application.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder, because there every task sees the same disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        # Several processes, as in local-cluster, need a shared folder like any cluster.
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbscore-"))
        folder = context.getCheckpointDir()
    return os.path.join(folder, f"plumbscore-{context.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`work_dir`, or below the folder of the :func:`scratch` block."""
    return os.path.join(_OWNER.get() or work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any Hadoop file system; a missing one is fine."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[None]:
    """Delete at the end of the block what was written to scratch paths within it.

    For jobs that run for months: read every lazy result before the block ends.
    """
    folder = scratch_path(spark, name)
    token = _OWNER.set(folder)
    try:
        yield
    finally:
        _OWNER.reset(token)
        delete_folder(spark, folder)


def materialize(df: DataFrame, name: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return the written table.

    The input is computed once however often the result is read, later readers prune
    columns and the folders of ``by``, and the table outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Repartition by ``keys`` so that every core has work in an iterative fit.

    Into ``partitions``, or as many as ``spark.sql.shuffle.partitions`` states, so a seeded
    fit does not depend on how the table was stored or on the size of the cluster.
    """
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
