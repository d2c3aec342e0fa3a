"""Projections, cleaning, labels, splits, casts and small aggregates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.registered import hash_sql, query, rounded, table
from plumbscore.functions import (
    fill_numbers,
    hash_uniform,
    indicator,
    join_text,
    parse_number,
    parse_time,
    result_json,
    row_text,
    split_text,
    weight_sum,
)
from plumbscore.operators.aggregates import global_sum, indicator_rate, series_extent, series_top, wide_metrics
from plumbscore.operators.curves import score_pairs
from plumbscore.operators.features import (
    feature_array,
    feature_columns,
    hash_split,
    label_frequency,
    label_table,
    prepare,
    random_split,
)
from plumbscore.operators.sampling import assign, period_sample, random_sample
from plumbscore.session import scratch_path
from plumbscore.sources.model_store import feature_pipeline_path, load_model, save_model

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLED_SQL = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.05) AS l_discount,
  CASE WHEN l_tax = 0 THEN 'NaN'::DOUBLE ELSE l_tax END AS l_tax, nullif(l_returnflag, 'A') AS l_returnflag
  FROM lineitem"""
FILLED_SQL = """l_quantity, l_extendedprice, coalesce(l_discount, 0) AS l_discount,
  CASE WHEN isnan(l_tax) THEN 0 ELSE l_tax END AS l_tax"""


def _with_holes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("l_returnflag"),
    )


@query("feature_projection", "SELECT * EXCLUDE (p_type) FROM part")
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    """All columns but the target."""
    part = table(spark, folder, "part")
    return part.select(feature_columns(part, "p_type"))


@query("na_fill", f"SELECT l_orderkey, l_linenumber, {FILLED_SQL}, l_returnflag FROM ({HOLED_SQL}) AS h")
def na_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Null and NaN numbers become 0, text stays as it is."""
    return fill_numbers(_with_holes(spark, folder))


@query(
    "feature_array",
    f"""SELECT l_orderkey, l_linenumber, a[1] AS f0, a[2] AS f1, a[3] AS f2, a[4] AS f3 FROM (
          SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice, l_discount, l_tax] AS a
          FROM (SELECT l_orderkey, l_linenumber, {FILLED_SQL} FROM ({HOLED_SQL}) AS h) AS f) AS v""",
)
def feature_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Features as one array, in column order."""
    made = feature_array(_with_holes(spark, folder), LINE_FEATURES)
    return made.select("l_orderkey", "l_linenumber", *[F.col("feature_array")[i].alias(f"f{i}") for i in range(4)])


@query(
    "label_index",
    """SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n,
       CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR)) - 1 AS DOUBLE) AS label
       FROM customer GROUP BY c_nationkey""",
)
def label_index(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by falling frequency, ties by text."""
    return label_table(table(spark, folder, "customer"), "c_nationkey")


@query("label_frequency", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def label_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per target value."""
    return label_frequency(table(spark, folder, "orders"), "o_orderpriority")


PIPELINE_SQL = f"""WITH f AS (SELECT l_orderkey, l_linenumber, {FILLED_SQL}, l_returnflag FROM ({HOLED_SQL}) AS h
                   WHERE l_returnflag IS NOT NULL),
        ranks AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS DOUBLE)
                  AS label FROM f GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, label
        FROM f JOIN ranks USING (l_returnflag)"""


@query("feature_pipeline", PIPELINE_SQL)
def feature_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Filled, assembled and indexed rows; rows without a target are left out."""
    data = prepare(_with_holes(spark, folder), "l_returnflag", LINE_FEATURES).data
    values = vector_to_array("features")
    return data.select("l_orderkey", "l_linenumber", *[values[i].alias(f"f{i}") for i in range(4)], "label")


@query("feature_pipeline_roundtrip", PIPELINE_SQL)
def feature_pipeline_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The fitted assembler and indexer, saved, loaded and applied."""
    lines = _with_holes(spark, folder)
    path = feature_pipeline_path(scratch_path(spark, "pipeline"))
    save_model(prepare(lines, "l_returnflag", LINE_FEATURES).model, path)
    known = fill_numbers(lines.where(F.col("l_returnflag").isNotNull()), LINE_FEATURES)
    values = vector_to_array("features")
    return load_model(path).transform(known).select(
        "l_orderkey", "l_linenumber", *[values[i].alias(f"f{i}") for i in range(4)], "label"
    )


@query(
    "score_pairs",
    """SELECT l_orderkey, l_linenumber, l_quantity / 64 AS score,
       CASE l_returnflag WHEN 'A' THEN 1e0 ELSE 0e0 END AS y FROM lineitem""",
)
def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of class 0 and its indicator, from a probability vector of three classes."""
    share = F.col("l_quantity") / 64
    label = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    scored = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        array_to_vector(F.array(share, (1 - share) / 2, (1 - share) / 2)).alias("probability"),
        label.alias("label"),
    )
    return score_pairs(scored, keep=["l_orderkey", "l_linenumber"])


@query(
    "indicator",
    "SELECT event_id, CASE WHEN value * value < 2500 THEN 1 ELSE 0 END AS inside FROM events",
)
def indicators(spark: SparkSession, folder: str) -> DataFrame:
    """1 where a condition holds."""
    inside = indicator(F.col("value") * F.col("value") < 2500).alias("inside")
    return table(spark, folder, "events").select("event_id", inside)


@query("random_columns", "SELECT event_id, TRUE AS in_range FROM events")
def random_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Seeded random numbers per row; their values depend on the partitioning, their range does not."""
    drawn = table(spark, folder, "events").select("event_id", F.rand(7).alias("x"), F.rand(11).alias("y"))
    return drawn.select("event_id", F.expr("x >= 0 AND x < 1 AND y >= 0 AND y < 1 AND x != y").alias("in_range"))


@query(
    "indicator_rate",
    f"""WITH u AS (SELECT {hash_sql("CAST(event_id AS VARCHAR)", "x")} AS x,
                          {hash_sql("CAST(event_id AS VARCHAR)", "y")} AS y FROM events)
        SELECT CAST(sum(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n,
        round(4e0 * sum(CASE WHEN x * x + y * y < 1 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM u""",
)
def pi_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Pi from the share of points inside the quarter circle."""
    x, y = hash_uniform("event_id", salt="x"), hash_uniform("event_id", salt="y")
    points = table(spark, folder, "events").select(x.alias("x"), y.alias("y"))
    return rounded(indicator_rate(points, F.col("x") * F.col("x") + F.col("y") * F.col("y") < 1, 4.0), ["rate"])


ORDER_HASH = hash_sql("CAST(o_orderkey AS VARCHAR)", "split")


@query(
    "hash_split",
    f"""SELECT o_orderkey, CASE WHEN {ORDER_HASH} < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def split_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Train and test rows by the hash of the key."""
    train, test = hash_split(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("random_split", "SELECT o_orderkey, o_custkey FROM orders")
def split_randomly(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's own split; which part a row is in depends on the partitioning, but it is in exactly one."""
    train, test = random_split(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), seed=3)
    return train.unionByName(test)


TRAFFIC_HASH = hash_sql("CAST(user_id AS VARCHAR)", "traffic")


@query(
    "ab_assignment",
    f"""SELECT event_id, CASE WHEN {TRAFFIC_HASH} < 0.5 THEN 'logisticRegression'
          WHEN {TRAFFIC_HASH} < 0.75 THEN 'randomForest' ELSE 'neuralNetwork' END AS model FROM events""",
)
def ab_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic by weights 2 : 1 : 1; all events of a user meet the same model."""
    models = ["logisticRegression", "randomForest", "neuralNetwork"]
    return assign(table(spark, folder, "events").select("event_id", "user_id"), "user_id", models, ["2", "1", "1"]).drop(
        "user_id"
    )


@query(
    "period_sample",
    " UNION ALL ".join(
        f"""SELECT {period} AS period, event_id FROM events
        WHERE {hash_sql("CAST(event_id AS VARCHAR)", f"period-{period}")} < 0.25"""
        for period in range(3)
    ),
)
def period_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A fresh quarter of the events for each of three periods."""
    events = table(spark, folder, "events").select("event_id")
    drawn = None
    for period in range(3):
        part = period_sample(events, "event_id", period, 0.25).select(F.lit(period).alias("period"), "event_id")
        drawn = part if drawn is None else drawn.unionAll(part)
    return drawn


@query("random_sample")
def sampled_randomly(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's own sample; it depends on the partitioning, so there is no SQL."""
    return random_sample(table(spark, folder, "events").select("event_id"), 0.25, 5)


@query("json_roundtrip", "SELECT doc_id, lang, source, n_chars, text FROM documents")
def json_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows rendered as JSON and parsed again; any text survives."""
    columns = ["doc_id", "lang", "source", "n_chars", "text"]
    documents = table(spark, folder, "documents").select(columns)
    rendered = documents.select(result_json(columns).alias("json"))
    return rendered.select(F.from_json("json", documents.schema).alias("row")).select("row.*")


@query(
    "parse_values",
    """SELECT p_partkey, TRY_CAST(p_retailprice || '' AS DOUBLE) AS price, TRY_CAST(p_name AS DOUBLE) AS name_number,
       TRY_CAST('2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS TIMESTAMP) AS day FROM part""",
)
def parse_values(spark: SparkSession, folder: str) -> DataFrame:
    """Text to numbers and times; what does not parse is null."""
    part = table(spark, folder, "part").select(
        "p_partkey",
        "p_name",
        F.col("p_retailprice").cast("string").alias("price_text"),
        F.concat(F.lit("2024-01-"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("day_text"),
    )
    return part.select(
        "p_partkey",
        parse_number("price_text").alias("price"),
        parse_number("p_name").alias("name_number"),
        parse_time("day_text").alias("day"),
    )


@query(
    "split_and_join",
    """SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, replace(p_name, ' ', ',') AS joined FROM part""",
)
def split_and_join(spark: SparkSession, folder: str) -> DataFrame:
    """Text split into items and joined again."""
    words = table(spark, folder, "part").select("p_partkey", split_text("p_name", " ").alias("words"))
    return words.select("p_partkey", F.explode("words").alias("word"), join_text("words").alias("joined"))


@query(
    "row_text",
    """SELECT '[' || o_orderkey || ',' || o_custkey || ',' || coalesce(nullif(o_orderstatus, 'P'), 'null') || ']'
       AS line FROM orders""",
)
def row_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as bracketed text."""
    orders = table(spark, folder, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return orders.select(row_text(["o_orderkey", "o_custkey", "status"]).alias("line"))


@query("global_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of a column."""
    return global_sum(table(spark, folder, "lineitem"), "l_linenumber")


@query(
    "weight_sum",
    """SELECT n_nationkey, round((c_lo + c_hi + c_mid) / 3e0, 6) AS total FROM (
         SELECT c_nationkey AS n_nationkey, min(c_custkey) AS c_lo, max(c_custkey) AS c_hi, count(*) AS c_mid
         FROM customer GROUP BY 1) AS w""",
)
def weight_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of weights that arrive as one text."""
    per_nation = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.concat_ws(",", F.min("c_custkey") / 3, F.max("c_custkey") / 3, F.count("*") / 3).alias("weights")
    )
    return per_nation.select("n_nationkey", F.round(weight_sum("weights"), 6).alias("total"))


@query("series_extent", "SELECT min(ts) AS first, max(ts) AS last FROM events")
def extent(spark: SparkSession, folder: str) -> DataFrame:
    """First and last time."""
    return series_extent(table(spark, folder, "events"), "ts")


@query(
    "series_top",
    """SELECT round(greatest(max(l_quantity), max(100 * l_discount), max(nullif(l_tax, l_tax))) * 1.1, 6) AS top
       FROM lineitem""",
)
def top(spark: SparkSession, folder: str) -> DataFrame:
    """Largest value over three series, one of them all null, plus ten percent."""
    series = table(spark, folder, "lineitem").select(
        "l_quantity",
        (F.col("l_discount") * 100).alias("percent"),
        F.nullif(F.col("l_tax"), F.col("l_tax")).alias("nothing"),
    )
    return rounded(series_top(series, ["l_quantity", "percent", "nothing"]), ["top"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "metrics_wide",
    f"""SELECT date_trunc('day', ts) AS date, {", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in EVENT_TYPES)}
        FROM events GROUP BY 1""",
)
def metrics_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per day, one column per series, all types of events."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date")
    daily = table(spark, folder, "events").groupBy(day, "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    return wide_metrics(daily, "date", "event_type", "value", EVENT_TYPES)
