"""Threshold curves, their summaries, and silhouettes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.registered import (
    SUMMARY_COLUMNS,
    SUMMARY_DOUBLES,
    curve_sql,
    query,
    rounded,
    summary_sql,
    table,
)
from plumbscore.operators.clustering import silhouette, vector_columns, vector_silhouette
from plumbscore.operators.curves import (
    binary_counts,
    binary_metrics,
    f_points,
    ks_points,
    pr_points,
    roc_extract,
    roc_points,
    threshold_curve,
    unscored,
)

QUANTITY_SQL = """SELECT l_quantity / 50 AS score, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y,
  l_linestatus, l_suppkey FROM lineitem"""
PRICE_SQL = "SELECT l_extendedprice AS score, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y FROM lineitem"
SMALL_SLICES = 2_000


def scored_lines(spark: SparkSession, folder: str, score: str = "l_quantity / 50", keys: Sequence[str] = ()) -> DataFrame:
    """Line items scored by one of their numbers; returned items are positive."""
    returned = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, folder, "lineitem").select(*keys, F.expr(score).alias("score"), returned.alias("y"))


def _quantity_curve(spark: SparkSession, folder: str) -> DataFrame:
    return threshold_curve(binary_counts(scored_lines(spark, folder)))


@query("binary_metrics", f"WITH {summary_sql(QUANTITY_SQL)} SELECT {SUMMARY_COLUMNS} FROM s")
def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All measures of a score with many ties."""
    return rounded(binary_metrics(scored_lines(spark, folder)), SUMMARY_DOUBLES)


@query("binary_metrics_fine", f"WITH {summary_sql(PRICE_SQL)} SELECT {SUMMARY_COLUMNS} FROM s")
def metrics_fine(spark: SparkSession, folder: str) -> DataFrame:
    """A score with hardly any ties."""
    return rounded(binary_metrics(scored_lines(spark, folder, "l_extendedprice")), SUMMARY_DOUBLES)


@query("binary_metrics_sliced", f"WITH {summary_sql(PRICE_SQL)} SELECT {SUMMARY_COLUMNS} FROM s")
def metrics_sliced(spark: SparkSession, folder: str) -> DataFrame:
    """The same through many small slices, as a table too large for one task would go."""
    pairs = scored_lines(spark, folder, "l_extendedprice")
    return rounded(binary_metrics(pairs, rows_per_slice=SMALL_SLICES), SUMMARY_DOUBLES)


@query(
    "binary_metrics_by_key",
    f"WITH {summary_sql(QUANTITY_SQL, ['l_linestatus'])} SELECT l_linestatus, {SUMMARY_COLUMNS} FROM s",
)
def metrics_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per line status."""
    pairs = scored_lines(spark, folder, keys=["l_linestatus"])
    return rounded(binary_metrics(pairs, keys=["l_linestatus"]), SUMMARY_DOUBLES)


@query(
    "binary_metrics_by_many_keys",
    f"WITH {summary_sql(QUANTITY_SQL, ['l_suppkey', 'l_linestatus'])} SELECT l_suppkey, l_linestatus, {SUMMARY_COLUMNS} FROM s",
)
def metrics_by_many_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per supplier and status, in slices."""
    keys = ["l_suppkey", "l_linestatus"]
    pairs = scored_lines(spark, folder, keys=keys)
    return rounded(binary_metrics(pairs, keys=keys, rows_per_slice=SMALL_SLICES), SUMMARY_DOUBLES)


@query(
    "confusion_counts",
    f"WITH {curve_sql(QUANTITY_SQL)} SELECT score AS threshold, p, n, tp, fp, pos - tp AS fn, neg - fp AS tn FROM c",
)
def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts at every threshold."""
    curve = _quantity_curve(spark, folder)
    return curve.select(
        "threshold", "p", "n", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn")
    )


ROC_SQL = f"""WITH {curve_sql(QUANTITY_SQL)},
    r AS (SELECT score AS threshold, fp / neg::DOUBLE AS fpr, tp / pos::DOUBLE AS tpr FROM c
          UNION ALL VALUES ('Infinity'::DOUBLE, 0e0, 0e0), ('-Infinity'::DOUBLE, 1e0, 1e0))"""


@query("roc_points", f"{ROC_SQL} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def roc(spark: SparkSession, folder: str) -> DataFrame:
    """ROC curve with both end points."""
    return rounded(roc_points(_quantity_curve(spark, folder)), ["fpr", "tpr"])


@query(
    "ks_points",
    f"{ROC_SQL} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(tpr - fpr, 6) AS ks FROM r",
)
def ks(spark: SparkSession, folder: str) -> DataFrame:
    """KS distance along the ROC curve."""
    return rounded(ks_points(_quantity_curve(spark, folder)), ["fpr", "tpr", "ks"])


@query(
    "pr_points",
    f"""WITH {curve_sql(QUANTITY_SQL)}
        SELECT score AS threshold, round(tp / pos::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision
        FROM c
        UNION ALL SELECT 'Infinity'::DOUBLE, 0, round(arg_max(p, score) / arg_max(p + n, score)::DOUBLE, 6) FROM g""",
)
def pr(spark: SparkSession, folder: str) -> DataFrame:
    """Precision-recall curve with its first point."""
    return rounded(pr_points(_quantity_curve(spark, folder)), ["recall", "precision"])


@query(
    "f1_curve",
    f"WITH {curve_sql(QUANTITY_SQL)} SELECT score AS threshold, round(2e0 * tp / (tp + fp + pos), 6) AS f FROM c",
)
def f1_curve(spark: SparkSession, folder: str) -> DataFrame:
    """F1 at every threshold."""
    return rounded(f_points(_quantity_curve(spark, folder)), ["f"])


PRICE_ROC_SQL = f"""WITH {curve_sql(PRICE_SQL)},
    r AS (SELECT score AS threshold, fp / neg::DOUBLE AS fpr, tp / pos::DOUBLE AS tpr FROM c
          UNION ALL VALUES ('Infinity'::DOUBLE, 0e0, 0e0), ('-Infinity'::DOUBLE, 1e0, 1e0))"""


@query(
    "roc_extract_first",
    f"""{PRICE_ROC_SQL} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r
        ORDER BY threshold DESC LIMIT 1000""",
)
def roc_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first 1000 points of a long ROC curve."""
    curve = threshold_curve(binary_counts(scored_lines(spark, folder, "l_extendedprice")))
    return rounded(roc_extract(curve), ["fpr", "tpr"])


@query(
    "roc_extract_even",
    f"""{PRICE_ROC_SQL},
        k AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) AS i, count(*) OVER () AS size FROM r),
        e AS (SELECT *, greatest(1e0, (size - 1) / 99e0) AS step FROM k)
        SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM e
        WHERE i = 1 OR i = size OR floor((i - 1) / step) > floor((i - 2) / step)""",
)
def roc_even(spark: SparkSession, folder: str) -> DataFrame:
    """About 100 points spread over a long ROC curve."""
    curve = threshold_curve(binary_counts(scored_lines(spark, folder, "l_extendedprice")))
    return rounded(roc_extract(curve, 100, "even"), ["fpr", "tpr"])


@query(
    "silhouette_fixed_assignment",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
       d AS (SELECT a.vec_id, a.label AS mine, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS total
             FROM e AS a, e AS b GROUP BY 1, 2, 3),
       ab AS (SELECT vec_id, max(n) FILTER (WHERE mine = other) AS own,
                max(total / nullif(n - 1, 0)) FILTER (WHERE mine = other) AS a,
                min(total / n) FILTER (WHERE mine <> other) AS b
              FROM d JOIN sizes ON sizes.label = d.other GROUP BY 1)
       SELECT count(*) AS rows, (SELECT count(*) FROM sizes) AS clusters,
         round(avg(CASE WHEN own = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6)
         AS silhouette FROM ab""",
)
def silhouette_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouette of the embeddings by their label; the SQL compares all pairs."""
    embeddings = table(spark, folder, "embeddings")
    vectors = embeddings.select(array_to_vector("embedding").alias("features"), "label")
    return rounded(vector_silhouette(vectors, "features", "label"), ["silhouette"])


@query(
    "silhouette_of_arrays",
    """WITH e AS (SELECT vec_id, vec_id % 3 AS part, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       sizes AS (SELECT part, label, count(*) AS n FROM e GROUP BY 1, 2),
       d AS (SELECT a.vec_id, a.part, a.label AS mine, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS total
             FROM e AS a JOIN e AS b ON a.part = b.part GROUP BY 1, 2, 3, 4),
       ab AS (SELECT vec_id, d.part, max(n) FILTER (WHERE mine = other) AS own,
                max(total / nullif(n - 1, 0)) FILTER (WHERE mine = other) AS a,
                min(total / n) FILTER (WHERE mine <> other) AS b
              FROM d JOIN sizes ON sizes.label = d.other AND sizes.part = d.part GROUP BY 1, 2)
       SELECT part, count(*) AS rows, (SELECT count(*) FROM sizes WHERE sizes.part = ab.part) AS clusters,
         round(avg(CASE WHEN own = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6)
         AS silhouette FROM ab GROUP BY part""",
)
def silhouette_of_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The same per third of the embeddings, straight from the arrays."""
    parts = table(spark, folder, "embeddings").withColumn("part", F.pmod("vec_id", F.lit(3)))
    return rounded(silhouette(parts, vector_columns("embedding", 64), "label", ["part"]), ["silhouette"])


@query(
    "silhouette_by_key",
    """WITH x AS (SELECT l_linestatus, l_returnflag AS c, l_quantity AS x1, round(l_discount * 100) AS x2,
                    round(l_tax * 100) AS x3 FROM lineitem),
       q AS (SELECT *, x1 * x1 + x2 * x2 + x3 * x3 AS xx FROM x),
       k AS (SELECT l_linestatus, c, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(xx) AS q
             FROM q GROUP BY 1, 2),
       d AS (SELECT q.l_linestatus, q.c = k.c AS own, q.x1, q.x2, q.x3, q.xx, q.c, k.n,
               q.xx + k.q / k.n - 2 * (q.x1 * k.s1 + q.x2 * k.s2 + q.x3 * k.s3) / k.n AS mean
             FROM q JOIN k ON q.l_linestatus = k.l_linestatus),
       s AS (SELECT l_linestatus, c, x1, x2, x3, max(mean * n / (n - 1)) FILTER (WHERE own) AS a,
               min(mean) FILTER (WHERE NOT own) AS b FROM d GROUP BY ALL),
       w AS (SELECT l_linestatus, c, x1, x2, x3, count(*) AS copies FROM q GROUP BY ALL)
       SELECT l_linestatus, CAST(sum(copies) AS BIGINT) AS rows, count(DISTINCT c) AS clusters,
         round(sum(copies * CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) / sum(copies), 6)
         AS silhouette
       FROM s JOIN w USING (l_linestatus, c, x1, x2, x3) GROUP BY 1""",
)
def silhouette_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouette of return flags in three integer features, per line status."""
    lines = table(spark, folder, "lineitem").select(
        "l_linestatus",
        "l_returnflag",
        "l_quantity",
        F.round(F.col("l_discount") * 100).alias("percent"),
        F.round(F.col("l_tax") * 100).alias("tax_percent"),
    )
    found = silhouette(lines, ["l_quantity", "percent", "tax_percent"], "l_returnflag", ["l_linestatus"])
    return rounded(found, ["silhouette"])


@query(
    "silhouette_many_clusters",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS x1, l_quantity AS x2,
                    CAST(l_quantity * 1000 + floor(l_extendedprice / 1000) AS BIGINT) AS c FROM lineitem),
       q AS (SELECT *, row_number() OVER () AS id, x1 * x1 + x2 * x2 AS xx FROM x),
       k AS (SELECT c, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(xx) AS q FROM q GROUP BY 1),
       d AS (SELECT id, q.c = k.c AS own, k.n, q.xx + (k.q - 2 * (q.x1 * k.s1 + q.x2 * k.s2)) / k.n AS mean FROM q CROSS JOIN k),
       s AS (SELECT id, max(n) FILTER (WHERE own) AS n, max(mean * n / nullif(n - 1, 0)) FILTER (WHERE own) AS a,
               min(mean) FILTER (WHERE NOT own) AS b FROM d GROUP BY 1)
       SELECT count(*) AS rows, (SELECT count(*) FROM k) AS clusters,
         round(avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette
       FROM s""",
)
def silhouette_many_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Silhouette of thousands of price and quantity cells, which are met in blocks; the SQL meets them all."""
    cell = (F.col("l_quantity") * 1000 + F.floor(F.col("l_extendedprice") / 1000)).cast("bigint")
    lines = table(spark, folder, "lineitem").select((F.col("l_extendedprice") / 1000).alias("price"), "l_quantity", cell.alias("cell"))
    return rounded(silhouette(lines, ["price", "l_quantity"], "cell"), ["silhouette"])


GAPS_SQL = """SELECT l_quantity / 50 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_returnflag AS flag,
  l_tax = 0 OR l_discount = 0.05 OR l_linenumber IN (1, 2) AS gap FROM lineitem"""


@query(
    "binary_metrics_with_gaps",
    f"""WITH {summary_sql(f"SELECT score, y FROM ({GAPS_SQL}) AS t WHERE NOT gap")}
    SELECT {SUMMARY_COLUMNS}, (SELECT count(*) FROM ({GAPS_SQL}) AS t WHERE gap) AS unscored FROM s""",
)
def binary_metrics_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Null and NaN scores and labels are left out of the curve and counted."""
    nan = F.lit(float("nan"))
    score = F.when(F.col("l_tax") == 0, nan).when(F.col("l_discount") == 0.05, None).otherwise(F.col("l_quantity") / 50)
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    y = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_linenumber") == 2, nan).otherwise(y)
    pairs = table(spark, folder, "lineitem").select(score.alias("score"), y.alias("y"))
    found = rounded(binary_metrics(pairs), SUMMARY_DOUBLES)
    return found.select("*", unscored(pairs).scalar().alias("unscored"))


HOT_SQL = """SELECT l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_linenumber <= 2 THEN -1 ELSE l_suppkey END AS key FROM lineitem"""


@query("binary_metrics_hot_key", f"WITH {summary_sql(HOT_SQL, ['key'])} SELECT key, {SUMMARY_COLUMNS} FROM s")
def metrics_hot_key(spark: SparkSession, folder: str) -> DataFrame:
    """Measures per key on a fine score; one key holds about a third of all rows and is cut into slices."""
    pairs = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"),
        F.when(F.col("l_linenumber") <= 2, F.lit(-1).cast("long")).otherwise(F.col("l_suppkey")).alias("key"),
    )
    return rounded(binary_metrics(pairs, keys=["key"], rows_per_slice=1_000), SUMMARY_DOUBLES)
