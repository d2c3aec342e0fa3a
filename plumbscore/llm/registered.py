"""The table of queries of this subpackage and the helpers its operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROWS_AT_ONCE = 256


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL it must agree with when there is one."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def text_of(column: str = "text") -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_part(key: str, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def map_rows(df: DataFrame, function: Callable[[list[dict]], Iterable[dict]], schema: str, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Apply ``function`` to lists of at most ``at_once`` rows inside the tasks.

    Rows travel as Arrow batches; only one short list of them is held as Python objects.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                found = list(function(batch.slice(start, at_once).to_pylist()))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=target)

    return df.mapInArrow(run, schema)

