"""Files, previews, requests and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.registered import query, table
from plumbscore.operators.aggregates import row_count
from plumbscore.session import materialize, scratch_path
from plumbscore.sources.files import (
    LoadSpec,
    TableCache,
    head,
    list_files,
    load_csv,
    number_rows,
    parse_requests,
    schema_table,
)
from plumbscore.sources.metric_store import MODES, all_metrics, append_metrics, latest_metrics, purge_metrics, read_metrics
from plumbscore.sources.model_store import select_by_requests


def _csv_copy(spark: SparkSession, folder: str, name: str, header: bool = True, sep: str = ",") -> str:
    path = scratch_path(spark, f"csv-{name}")
    table(spark, folder, name).write.option("header", header).option("sep", sep).csv(path)
    return path


@query(
    "csv_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written as CSV and read back with inferred types."""
    loaded = load_csv(spark, LoadSpec(_csv_copy(spark, folder, "orders"), "true", ",", "true"))
    return loaded.select(
        F.col("o_orderkey").cast("bigint"),
        F.col("o_custkey").cast("bigint"),
        "o_orderstatus",
        F.col("o_totalprice").cast("double"),
        F.col("o_orderdate").cast("timestamp_ntz"),
        "o_orderpriority",
    )


@query(
    "csv_headerless",
    """SELECT CAST(p_partkey AS VARCHAR) AS _c0, p_name AS _c1, p_brand AS _c2, p_type AS _c3,
       CAST(p_size AS VARCHAR) AS _c4, p_retailprice AS _c5 FROM part""",
)
def csv_headerless(spark: SparkSession, folder: str) -> DataFrame:
    """A tab-separated file without header: numbered columns of text."""
    path = _csv_copy(spark, folder, "part", header=False, sep="\t")
    return load_csv(spark, LoadSpec(path, sep="\t")).withColumn("_c5", F.col("_c5").cast("double"))


@query(
    "load_cached",
    """SELECT o_orderstatus, CAST(2 * count(*) AS BIGINT) AS row_copies,
       round(2 * sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def load_cached(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads of one request share one persisted table."""
    cache = TableCache(spark)
    spec = LoadSpec(_csv_copy(spark, folder, "orders"), True, ",", True)
    first, second = cache.load(spec), cache.load(spec)
    both = first.select("o_orderstatus", "o_totalprice").unionAll(second.select("o_orderstatus", "o_totalprice"))
    counted = both.groupBy("o_orderstatus").agg(
        F.count("*").alias("row_copies"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    if "InMemoryTableScan" not in counted._jdf.queryExecution().executedPlan().toString():
        raise RuntimeError("the load was not read from the cache")
    found = materialize(counted, "cached")
    cache.release()
    return found


@query(
    "schema_inferred",
    """SELECT CAST(ordinal_position - 1 AS INTEGER) AS pos, column_name AS name,
       CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
         WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp' END AS type,
       is_nullable = 'YES' AS nullable
       FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
def schema_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Types found by reading a whole CSV file."""
    return schema_table(load_csv(spark, LoadSpec(_csv_copy(spark, folder, "lineitem"), True, ",", True)))


@query("head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First ten rows by key."""
    return head(table(spark, folder, "orders"), order_by=["o_orderkey"])


@query("row_count", "SELECT count(*) AS linecount FROM lineitem")
def count_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a table."""
    return row_count(table(spark, folder, "lineitem"))


@query("list_files", "SELECT event_type, count(*) AS rows, 'part' AS names FROM events GROUP BY 1")
def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree written with one sub-folder per event type, and the rows in the listed files."""
    path = scratch_path(spark, "listing")
    table(spark, folder, "events").hint("rebalance", "event_type").write.partitionBy("event_type").parquet(path)
    files = list_files(spark, path, recursive=True, pattern="*.parquet")
    listed = files.withColumn("event_type", F.regexp_extract("path", "event_type=([^/]+)/", 1))
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"))
    counted = listed.join(rows.agg(F.count("*").alias("rows")), ["path", "length"])
    # Every written file has a name of its own that begins the same.
    return counted.groupBy("event_type").agg(
        F.sum("rows").alias("rows"), F.array_join(F.collect_set(F.substring("name", 1, 4)), ",").alias("names")
    )


@query("number_rows", "SELECT range AS id FROM range(1, (SELECT count(*) + 1 FROM orders))")
def numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The numbers 1 to n, for as many rows as a table has."""
    return number_rows(spark, table(spark, folder, "orders").count())


@query(
    "requests_from_json",
    """SELECT page_id, url AS filepath, CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS "hasHeader",
       CASE WHEN page_id % 3 = 0 THEN chr(9) ELSE ',' END AS sep, 'false' AS "inferSchema",
       length(url) > 0 AS valid FROM pages""",
)
def requests_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """Load requests as JSON text, some with fields left out."""
    body = F.to_json(
        F.struct(
            F.col("url").alias("filepath"),
            F.when(F.col("page_id") % 2 == 0, "true").alias("hasHeader"),
            F.when(F.col("page_id") % 3 == 0, "\t").alias("sep"),
        )
    )
    requests = table(spark, folder, "pages").select("page_id", body.alias("body"))
    return parse_requests(requests, "body").drop("body")


@query(
    "select_models",
    """SELECT p_partkey, p_brand AS model FROM part WHERE p_brand IN (
         SELECT trim(unnest(string_split('Brand#' || c_nationkey || ', Brand#' || (c_custkey % 5), ',')))
         FROM customer)""",
)
def select_models(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a listing that are named in comma-separated selections."""
    listing = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("model"))
    names = F.concat(
        F.lit("Brand#"), F.col("c_nationkey").cast("string"), F.lit(", Brand#"), (F.col("c_custkey") % 5).cast("string")
    )
    requests = table(spark, folder, "customer").select(names.alias("names"))
    return select_by_requests(listing, requests, "names")


def _event_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("model"),
        F.lit("value").alias("metric"),
        "value",
        F.pmod("event_id", F.lit(4)).alias("batch"),
    )


@query(
    "metric_sink",
    """SELECT event_id AS seq, ts AS date, event_type AS model, 'value' AS metric, value, event_id % 4 AS batch
       FROM events""",
)
def metric_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics stored in batches; writing them twice changes nothing."""
    root = scratch_path(spark, "metrics")
    for _ in range(2):
        append_metrics(_event_metrics(spark, folder), root, "champion")
    return all_metrics(spark, root, "champion")


@query(
    "metric_scan",
    """SELECT event_id AS seq, ts AS date, event_type AS model, 'value' AS metric, value, event_id % 4 AS batch
       FROM events""",
)
def metric_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All stored metrics in order."""
    root = scratch_path(spark, "metrics")
    append_metrics(_event_metrics(spark, folder), root, "abtesting")
    return read_metrics(spark, root, "abtesting")


@query(
    "metrics_latest",
    """SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderdate AS date, o_totalprice AS value
       FROM orders ORDER BY o_orderkey DESC LIMIT 1000""",
)
def metrics_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Document numbers kept as text sort as numbers."""
    documents = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"),
    )
    return latest_metrics(documents, "_id", 1000)


@query(
    "metric_purge",
    """SELECT m.mode, count(*) AS stored FROM events, (VALUES ('champion'), ('abtesting')) AS m(mode) GROUP BY 1""",
)
def metric_purge(spark: SparkSession, folder: str) -> DataFrame:
    """Three modes stored, one purged."""
    root = scratch_path(spark, "metrics")
    for mode in MODES:
        append_metrics(_event_metrics(spark, folder), root, mode)
    purge_metrics(spark, root, "multiarm")
    kept = None
    for mode in MODES:
        stored = all_metrics(spark, root, mode).select(F.lit(mode).alias("mode"))
        kept = stored if kept is None else kept.unionAll(stored)
    return kept.groupBy("mode").agg(F.count("*").alias("stored"))
