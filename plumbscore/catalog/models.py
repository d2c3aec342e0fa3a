"""Models trained on rules they must recover, saved models, and whole training jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.catalog.registered import hash_sql, query, rounded, summary_sql, table
from plumbscore.operators.features import hash_split, prepare
from plumbscore.plans.deployment import baseline_silhouette, canary, champion, window_metrics
from plumbscore.plans.training import coefficient_table, fit, fit_score, prepare_parts, score, score_all, train_evaluate
from plumbscore.session import materialize, scratch_path, spread
from plumbscore.sources.model_store import feature_pipeline_path, load_model, model_path, registry, save_model

DEPLOYED = {"logisticRegression": {}, "neuralNetwork": {"seed": 1}, "randomForest": {"seed": 1}}
LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_HASH = hash_sql("l_orderkey || ':' || l_linenumber", "split")
TEST_SQL = f"SELECT l_quantity, l_quantity > 25 AS target FROM lineitem WHERE {LINE_HASH} >= 0.8"


def rule_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items whose target is whether the quantity is above 25."""
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_quantity", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("target")
    )
    return spread(lines, *LINE_KEY)


def _rule_predictions(spark: SparkSession, folder: str, name: str, **params: int) -> DataFrame:
    prepared, (train, test) = prepare_parts(rule_lines(spark, folder), "target", ["l_quantity"], LINE_KEY)
    names = F.array(*[F.lit(value) for value in prepared.labels])
    scored = fit_score(name, train, test, **params)
    return (
        scored.groupBy((names[F.col("prediction").cast("int")] == "1").alias("predicted"))
        .agg(F.count("*").alias("rows"))
    )


RULE_SQL = f"SELECT target AS predicted, count(*) AS rows FROM ({TEST_SQL}) AS t GROUP BY 1"


@query("lr_rule", RULE_SQL)
def lr_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Logistic regression recovers the rule on held-out rows."""
    return _rule_predictions(spark, folder, "logisticRegression")


@query("rf_rule", RULE_SQL)
def rf_rule(spark: SparkSession, folder: str) -> DataFrame:
    """A random forest recovers the rule on held-out rows."""
    return _rule_predictions(spark, folder, "randomForest", seed=1)


@query("nn_rule", RULE_SQL)
def nn_rule(spark: SparkSession, folder: str) -> DataFrame:
    """A neural network recovers the rule on held-out rows."""
    return _rule_predictions(spark, folder, "neuralNetwork", seed=1)


def grouped_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with one feature that falls into five far-apart groups."""
    group = F.substring("o_orderpriority", 1, 1).cast("int")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", (group * 1000 + F.pmod("o_orderkey", F.lit(10))).cast("double").alias("x")
    )
    return spread(orders, "o_orderkey")


@query(
    "kmeans_groups",
    "SELECT o_orderpriority AS lowest, o_orderpriority AS highest, count(*) AS rows FROM orders GROUP BY 1",
)
def kmeans_groups(spark: SparkSession, folder: str) -> DataFrame:
    """K-means recovers the five groups."""
    orders = grouped_orders(spark, folder)
    model = fit("kmeans", orders, columns=["x"], seed=1)
    return score(model, orders).groupBy("prediction").agg(
        F.min("o_orderpriority").alias("lowest"), F.max("o_orderpriority").alias("highest"), F.count("*").alias("rows")
    ).drop("prediction")


MAJORITY_SQL = """majority AS (
      SELECT l_quantity > 25 AS target FROM lineitem GROUP BY 1
      ORDER BY count(*) DESC, CAST(CAST(l_quantity > 25 AS INTEGER) AS VARCHAR) LIMIT 1)"""
EVALUATE_SQL = f"""WITH {MAJORITY_SQL},
    {summary_sql(f"SELECT CASE WHEN target = (FROM majority) THEN 1e0 ELSE 0e0 END AS score, "
                 f"CASE WHEN target = (FROM majority) THEN 1 ELSE 0 END AS y FROM ({TEST_SQL}) AS t")}
    SELECT positives, negatives, round(auc, 6) AS auc, round(auprc, 6) AS auprc, round(max_f1, 6) AS max_f1,
      round(ks_fpr, 6) AS ks_fpr, round(max_ks, 6) AS max_ks FROM s"""


def _evaluated(spark: SparkSession, folder: str, name: str, seed: int | None = None) -> DataFrame:
    lines = rule_lines(spark, folder)
    result = train_evaluate(lines, "target", name, ["l_quantity"], LINE_KEY, seed=seed, split_salt="split")
    return rounded(
        result.select(
            "positives",
            "negatives",
            F.col("areaUnderROC").alias("auc"),
            "auprc",
            F.col("maxF1.f1").alias("max_f1"),
            F.col("maxKS.fpr").alias("ks_fpr"),
            F.col("maxKS.ks").alias("max_ks"),
        ),
        ["auc", "auprc", "max_f1", "ks_fpr", "max_ks"],
    )


@query("train_evaluate_lr", EVALUATE_SQL)
def train_evaluate_lr(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job with logistic regression; a model that recovers the rule ranks like the rule."""
    return _evaluated(spark, folder, "logisticRegression")


@query("train_evaluate_rf", EVALUATE_SQL)
def train_evaluate_rf(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job with a random forest."""
    return _evaluated(spark, folder, "randomForest", 1)


@query("train_evaluate_nn", EVALUATE_SQL)
def train_evaluate_nn(spark: SparkSession, folder: str) -> DataFrame:
    """Whole job with a neural network."""
    return _evaluated(spark, folder, "neuralNetwork", 1)


ORDER_TEST_HASH = hash_sql("CAST(o_orderkey AS VARCHAR)", "split")


@query(
    "train_evaluate_kmeans",
    f"""WITH x AS (SELECT o_orderpriority AS c, 1000e0 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
                     + o_orderkey % 10 AS x FROM orders WHERE {ORDER_TEST_HASH} >= 0.8),
        k AS (SELECT c, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1),
        d AS (SELECT x.x, x.c, x.c = k.c AS own, k.n, x.x * x.x + k.q / k.n - 2 * x.x * k.s / k.n AS mean
              FROM x, k),
        s AS (SELECT x, c, max(mean * n / (n - 1)) FILTER (WHERE own) AS a, min(mean) FILTER (WHERE NOT own) AS b
              FROM d GROUP BY 1, 2)
        SELECT count(*) AS rows, count(DISTINCT x.c) AS clusters,
          round(avg(CASE WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END), 6) AS silhouette
        FROM x JOIN s USING (x, c)""",
)
def train_evaluate_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Whole clustering job on the five groups."""
    orders = grouped_orders(spark, folder).withColumn("target", F.substring("o_orderpriority", 1, 1))
    result = train_evaluate(orders, "target", "kmeans", ["x"], "o_orderkey", seed=1, split_salt="split")
    return rounded(result.drop("estimator"), ["silhouette"])


@query("lr_coefficients")
def lr_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Weights of a three-class logistic regression, one row per class and feature."""
    features = ["l_quantity", "l_discount", "l_tax"]
    prepared = prepare(table(spark, folder, "lineitem"), "l_returnflag", features)
    model = fit("logisticRegression", prepared.data)
    return coefficient_table(prepared.data, model, features)


@query("lr_coefficients_rebuilt", "SELECT l_returnflag, count(*) AS rows, CAST(0 AS BIGINT) AS unlike FROM lineitem GROUP BY 1")
def lr_coefficients_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities rebuilt from the table of weights are those of the model."""
    features = ["l_quantity", "l_discount", "l_tax"]
    prepared = prepare(table(spark, folder, "lineitem"), "l_returnflag", features)
    model = fit("logisticRegression", prepared.data)
    weights = {(r["class"], r["feature"]): r["weight"] for r in coefficient_table(prepared.data, model, features).collect()}
    scored = score(model, prepared.data).withColumn("p", vector_to_array("probability"))
    grown = []
    for label in range(len(prepared.labels)):
        margin = F.lit(weights[label, "Intercept"])
        for name in features:
            margin = margin + F.col(name) * weights[label, name]
        grown.append(F.exp(margin).alias(f"e{label}"))
    rebuilt = scored.select("l_returnflag", "p", *grown)
    total = sum((F.col(f"e{label}") for label in range(len(grown))), F.lit(0.0))
    unlike = F.lit(False)
    for label in range(len(grown)):
        unlike = unlike | (F.abs(F.col("p")[label] - F.col(f"e{label}") / total) > 1e-9)
    return rebuilt.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if(unlike).alias("unlike"))


@query(
    "model_registry",
    """SELECT * FROM (VALUES
         ('kmeans', 0, 'org.apache.spark.ml.feature.VectorAssembler'),
         ('kmeans', 1, 'org.apache.spark.ml.clustering.KMeansModel'),
         ('logistic+regression 1', 0, 'org.apache.spark.ml.feature.VectorAssembler'),
         ('logistic+regression 1', 1, 'org.apache.spark.ml.classification.LogisticRegressionModel')) AS v(model, stage, class)""",
)
def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Two models saved and listed by stage."""
    root = scratch_path(spark, "registry")
    orders = grouped_orders(spark, folder)
    save_model(fit("kmeans", orders, columns=["x"], seed=1), model_path(root, "kmeans"))
    lines = rule_lines(spark, folder).withColumnRenamed("target", "label")
    save_model(fit("logisticRegression", lines, columns=["l_quantity"]), model_path(root, "logistic+regression 1"))
    return registry(spark, model_path(root, "")).select("model", "stage", "class")


@query(
    "model_roundtrip",
    """SELECT l_quantity > 25 AS positive, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM lineitem GROUP BY 1""",
)
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A saved and reloaded model scores every row as before."""
    lines = rule_lines(spark, folder).withColumnRenamed("target", "label")
    model = fit("logisticRegression", lines, columns=["l_quantity"])
    path = model_path(scratch_path(spark, "roundtrip"), "logisticRegression")
    save_model(model, path)
    both = score(load_model(path), score(model, lines, "before", 1), "after", 1)
    return both.groupBy((F.col("before") > 0.5).alias("positive")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("changed")
    )


MONTHS_SQL = """SELECT m.model, time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS date,
    CASE WHEN (l_quantity > 25) = (FROM majority) THEN 1e0 ELSE 0e0 END AS score,
    CASE WHEN (l_quantity > 25) = (FROM majority) THEN 1 ELSE 0 END AS y
  FROM lineitem, (VALUES ('logisticRegression'), ('neuralNetwork'), ('randomForest')) AS m(model)"""


@query(
    "deployed_models",
    f"""WITH {MAJORITY_SQL}, {summary_sql(MONTHS_SQL, ["date", "model"])},
        r AS (SELECT date, model, auc, row_number() OVER (PARTITION BY date ORDER BY auc DESC, model) AS place FROM s)
        SELECT date, model AS winner, round(auc, 6) AS winner_value, lag(model) OVER (ORDER BY date) AS champion
        FROM r WHERE place = 1""",
)
def deployed_models(spark: SparkSession, folder: str) -> DataFrame:
    """Three trained models score all rows; champions per 30 days of shipping."""
    lines = rule_lines(spark, folder)
    prepared = prepare(lines, "target", ["l_quantity"])
    train = materialize(hash_split(prepared.data, LINE_KEY)[0].select("features", "label"), "train")
    models = {name: fit(name, train, **params) for name, params in DEPLOYED.items()}
    shipped = table(spark, folder, "lineitem").select(
        "l_shipdate", "l_quantity", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("target")
    )
    labelled = prepared.model.transform(shipped)
    scored = score_all(models, labelled, ["l_shipdate", "label"])
    pairs = scored.withColumn("y", F.when(F.col("label") == 0, 1.0).otherwise(0.0))
    return rounded(champion(window_metrics(pairs, "l_shipdate", "30 days")), ["winner_value"])


NOISY_TARGET = """CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 = 0 THEN 1 - {rule} ELSE {rule} END"""
PRICE_TARGET = NOISY_TARGET.format(rule="CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END")
PRICE_SQL = f"SELECT l_extendedprice AS price, {PRICE_TARGET} AS target, {LINE_HASH} >= 0.8 AS test FROM lineitem"


@query(
    "train_evaluate_noisy",
    f"""WITH lines AS ({PRICE_SQL}),
        majority AS (SELECT target FROM lines GROUP BY 1 ORDER BY count(*) DESC, target LIMIT 1),
        {summary_sql("SELECT CASE WHEN (FROM majority) = 1 THEN price ELSE -price END AS score, "
                     "CASE WHEN target = (FROM majority) THEN 1 ELSE 0 END AS y FROM lines WHERE test")}
        SELECT positives, negatives, round(auc, 6) AS auc, round(auprc, 6) AS auprc, round(max_f1, 6) AS max_f1,
          round(ks_fpr, 6) AS ks_fpr, round(ks_tpr, 6) AS ks_tpr, round(max_ks, 6) AS max_ks,
          1e0 AS last_fpr, 1e0 AS last_tpr, CASE WHEN (FROM majority) = 1 THEN -1e0 ELSE 1e0 END AS slope,
          CAST(0 AS BIGINT) AS without_target, (SELECT count(*) FROM lines) AS reloaded_alike FROM s""",
)
def train_evaluate_noisy(spark: SparkSession, folder: str) -> DataFrame:
    """A job on a target with noise: one feature with many values ranks like that feature; its models are saved.

    The ROC must reach (1, 1), and the saved models, loaded again, must tell the classes as the feature does.
    """
    data_dir = scratch_path(spark, "noisy")
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, "l_extendedprice", F.expr(PRICE_TARGET).alias("target"))
    result = train_evaluate(
        lines, "target", "logisticRegression", ["l_extendedprice"], LINE_KEY, split_salt="split", data_dir=data_dir
    )
    prepared = load_model(feature_pipeline_path(data_dir)).transform(lines)
    loaded = score(load_model(model_path(data_dir, "logisticRegression")), prepared, "p", 1)
    slope = F.signum(F.element_at("coefficients", "l_extendedprice"))
    middle = loaded.agg(F.max(F.when(F.col("p") > 0.5, F.col("l_extendedprice"))).alias("high"),
                        F.min(F.when(F.col("p") <= 0.5, F.col("l_extendedprice"))).alias("low"),
                        F.min(F.when(F.col("p") > 0.5, F.col("l_extendedprice"))).alias("high_from"),
                        F.max(F.when(F.col("p") <= 0.5, F.col("l_extendedprice"))).alias("low_to"),
                        F.count("*").alias("rows"))
    # The probability is monotone in the only feature: one side of some price is one class.
    alike = middle.select(F.when((F.col("high_from") > F.col("low_to")) | (F.col("high") < F.col("low")), F.col("rows")))
    found = result.select(
        "positives",
        "negatives",
        F.col("areaUnderROC").alias("auc"),
        "auprc",
        F.col("maxF1.f1").alias("max_f1"),
        F.col("maxKS.fpr").alias("ks_fpr"),
        F.col("maxKS.tpr").alias("ks_tpr"),
        F.col("maxKS.ks").alias("max_ks"),
        F.element_at("roc", -1)["fpr"].alias("last_fpr"),
        F.element_at("roc", -1)["tpr"].alias("last_tpr"),
        slope.alias("slope"),
        F.col("rowsWithoutTarget").alias("without_target"),
        alike.scalar().alias("reloaded_alike"),
    )
    return rounded(found, ["auc", "auprc", "max_f1", "ks_fpr", "ks_tpr", "max_ks"])


FEATURE_NAMES = {"by_discount": "l_discount", "by_price": "l_extendedprice", "by_quantity": "l_quantity"}
MONTH_RULE = """CASE CAST(floor(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) / 30) AS INTEGER) % 3
    WHEN 0 THEN CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END
    WHEN 1 THEN CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END
    ELSE CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END END"""
MONTH_TARGET = NOISY_TARGET.format(rule=MONTH_RULE)
BY_FEATURE_SQL = f"""SELECT m.model, time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS date,
    CASE m.model WHEN 'by_discount' THEN l_discount WHEN 'by_price' THEN l_extendedprice ELSE l_quantity END AS score,
    {MONTH_TARGET} AS y FROM lineitem, (VALUES ('by_discount'), ('by_price'), ('by_quantity')) AS m(model)"""


@query(
    "deployed_models_by_feature",
    f"""WITH {summary_sql(BY_FEATURE_SQL, ["date", "model"])},
        r AS (SELECT date, model, auc, row_number() OVER (PARTITION BY date ORDER BY auc DESC, model) AS place FROM s)
        SELECT date, model AS winner, round(auc, 6) AS winner_value, lag(model) OVER (ORDER BY date) AS champion
        FROM r WHERE place = 1""",
)
def deployed_models_by_feature(spark: SparkSession, folder: str) -> DataFrame:
    """Three models, each trained on one feature; which of them is best changes every 30 days."""
    rule = MONTH_TARGET.replace("datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))", "unix_date(CAST(l_shipdate AS DATE))")
    lines = table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_shipdate", *FEATURE_NAMES.values(), F.expr(rule).cast("double").alias("label")
    )
    train = materialize(hash_split(lines, LINE_KEY)[0].select("label", *FEATURE_NAMES.values()), "train")
    models = {name: fit("logisticRegression", train, columns=[feature]) for name, feature in FEATURE_NAMES.items()}
    # Several fitted assemblers write the same column, so each model adds its score alone.
    columns = ["l_shipdate", "label", *FEATURE_NAMES.values()]
    scored = lines.select(*columns)
    for name, model in models.items():
        scored = score(model, scored, name, 1)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("score")) for n in models]))
    long = scored.select("l_shipdate", F.col("label").alias("y"), pairs.alias("e")).select("l_shipdate", "y", "e.*")
    return rounded(champion(window_metrics(long, "l_shipdate", "30 days")), ["winner_value"])


@query(
    "canary_model",
    f"""WITH x AS (SELECT time_bucket(INTERVAL 90 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS date,
                     o_orderpriority AS c, 1000e0 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + o_orderkey % 10 AS x,
                     {ORDER_TEST_HASH} < 0.8 AS trained FROM orders),
        parts AS (SELECT date AS part, c, x FROM x UNION ALL SELECT TIMESTAMP '1900-01-01', c, x FROM x WHERE trained),
        k AS (SELECT part, c, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM parts GROUP BY 1, 2),
        d AS (SELECT p.part, p.x, p.c, p.c = k.c AS own, k.n, p.x * p.x + k.q / k.n - 2 * p.x * k.s / k.n AS mean
              FROM (SELECT DISTINCT * FROM parts) AS p JOIN k ON p.part = k.part),
        s AS (SELECT part, x, c, max(mean * n / nullif(n - 1, 0)) FILTER (WHERE own) AS a, max(n) FILTER (WHERE own) AS n,
                min(mean) FILTER (WHERE NOT own) AS b FROM d GROUP BY 1, 2, 3),
        r AS (SELECT part, count(*) AS rows, count(DISTINCT c) AS clusters,
                avg(CASE WHEN n = 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette
              FROM parts JOIN s USING (part, x, c) GROUP BY 1)
        SELECT part AS date, rows, clusters, round(silhouette, 6) AS silhouette,
          round(silhouette - (SELECT silhouette FROM r WHERE part = TIMESTAMP '1900-01-01'), 6) AS drift,
          abs(silhouette - (SELECT silhouette FROM r WHERE part = TIMESTAMP '1900-01-01')) > 0.1 AS drifted
        FROM r WHERE part > TIMESTAMP '1900-01-01'""",
)
def canary_model(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted clustering as canary over 90 days of orders, against its training rows."""
    group = F.substring("o_orderpriority", 1, 1).cast("int")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", (group * 1000 + F.pmod("o_orderkey", F.lit(10))).cast("double").alias("x")
    )
    trained = materialize(hash_split(spread(orders, "o_orderkey"), "o_orderkey")[0].select("x"), "train")
    model = fit("kmeans", trained, columns=["x"], seed=1)
    baseline = baseline_silhouette(trained, ["x"], model)
    return rounded(canary(orders, "o_orderdate", "90 days", ["x"], model, baseline), ["silhouette", "drift"])
