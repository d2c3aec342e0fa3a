"""Reading and inspecting delimited files, and row generators."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of a load request.
REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("filepath", T.StringType()),
        T.StructField("hasHeader", T.StringType()),
        T.StructField("sep", T.StringType()),
        T.StructField("inferSchema", T.StringType()),
    ]
)


@dataclass(frozen=True)
class LoadSpec:
    """What identifies a loaded file. Flags may be booleans or text."""

    filepath: str
    hasHeader: str | bool = "false"
    sep: str = ","
    inferSchema: str | bool = "false"

    def __post_init__(self) -> None:
        for name in ("hasHeader", "inferSchema"):
            text = str(getattr(self, name)).strip().lower()
            if text not in ("true", "false"):
                raise ValueError(f"{name} must be true or false, not {text!r}")
            object.__setattr__(self, name, text)

    @classmethod
    def from_json(cls, text: str) -> LoadSpec:
        """The request in a JSON object; only ``filepath`` is required."""
        given = json.loads(text)
        return cls(**{name: given[name] for name in REQUEST_SCHEMA.names if name in given})


def load_csv(spark: SparkSession, spec: LoadSpec) -> DataFrame:
    """Read a delimited file; without a header the columns are ``_c0, _c1, ...``.

    Inferring types reads the file once more; without it every column is text.
    """
    return (
        spark.read.format("csv")
        .option("header", spec.hasHeader)
        .option("sep", spec.sep)
        .option("inferSchema", spec.inferSchema)
        .load(spec.filepath)
    )


def listing_digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """Number of files below a path, and a digest of their paths, lengths and times; no file is opened."""
    marks = list_files(spark, path).select(F.xxhash64("path", "length", "modified").cast("decimal(38,0)").alias("mark"))
    row = marks.agg(F.count("*").alias("n"), F.sum("mark").alias("mark")).first()
    return row["n"], str(row["mark"])


class TableCache:
    """Keeps the most recently used loads persisted, at most ``capacity`` of them.

    A load is read again when a file below its path has another length or time, or files came or went.
    """

    def __init__(self, spark: SparkSession, capacity: int = 1) -> None:
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self._spark = spark
        self._capacity = capacity
        self._tables: OrderedDict[LoadSpec, tuple[tuple[int, str], DataFrame]] = OrderedDict()

    def load(self, spec: LoadSpec) -> DataFrame:
        """The persisted table for ``spec``, read on first use and after a change of its files."""
        # Taken before the read: a change in between is seen at the next load.
        digest = listing_digest(self._spark, spec.filepath)
        if spec in self._tables:
            known, table = self._tables[spec]
            if known == digest:
                self._tables.move_to_end(spec)
                return table
            self.release(spec)
        while len(self._tables) >= self._capacity:
            _, (_, oldest) = self._tables.popitem(last=False)
            oldest.unpersist()
        self._tables[spec] = digest, load_csv(self._spark, spec).persist()
        return self._tables[spec][1]

    def release(self, spec: LoadSpec | None = None) -> None:
        """Unpersist one table, or all."""
        for known in [spec] if spec is not None else list(self._tables):
            _, table = self._tables.pop(known, (None, None))
            if table is not None:
                table.unpersist()


def schema_table(df: DataFrame) -> DataFrame:
    """One row ``(pos, name, type, nullable)`` per column."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, name string, type string, nullable boolean")


def head(df: DataFrame, rows: int = 10, order_by: Sequence[str | Column] = ()) -> DataFrame:
    """The first rows; repeatable when ``order_by`` is a unique key."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def list_files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """``(path, name, length, modified)`` of the files in a folder of any Hadoop file system.

    Only metadata columns are selected, so no file is opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def joined_names(files: DataFrame) -> DataFrame:
    """All file names of a listing in one comma-separated text."""
    return files.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def number_rows(spark: SparkSession, n: int) -> DataFrame:
    """The numbers 1 to n."""
    return spark.range(1, n + 1)


def parse_requests(df: DataFrame, column: str) -> DataFrame:
    """Parse JSON load requests and fill in the defaults; ``valid`` is false without a path."""
    parsed = df.withColumn("__request", F.from_json(column, REQUEST_SCHEMA))
    request = F.col("__request")
    return parsed.select(
        *df.columns,
        request["filepath"].alias("filepath"),
        F.lower(F.coalesce(request["hasHeader"], F.lit("false"))).alias("hasHeader"),
        F.coalesce(request["sep"], F.lit(",")).alias("sep"),
        F.lower(F.coalesce(request["inferSchema"], F.lit("false"))).alias("inferSchema"),
        F.coalesce(F.length(request["filepath"]) > 0, F.lit(False)).alias("valid"),
    )
