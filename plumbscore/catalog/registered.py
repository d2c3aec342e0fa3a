"""The table of queries and the helpers they share."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


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
    """One of the test tables, with times read in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """``df`` with some doubles rounded, so that the order of a sum does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def hash_sql(key: str, salt: str) -> str:
    """SQL of ``hash_uniform`` for a key that is already text."""
    return f"(CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT) / 4294967296e0)"


def curve_sql(source: str, keys: Sequence[str] = ()) -> str:
    """CTEs ``g`` and ``c``: counts and running counts of a relation with score and y."""
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""
    g AS (
      SELECT {by}score, count(*) FILTER (WHERE y > 0.5) AS p, count(*) FILTER (WHERE y <= 0.5) AS n
      FROM ({source}) AS pairs GROUP BY {by}score
    ),
    c AS (
      SELECT {by}score, p, n,
        CAST(sum(p) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
        CAST(sum(n) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
        CAST(sum(p) OVER ({part}) AS BIGINT) AS pos,
        CAST(sum(n) OVER ({part}) AS BIGINT) AS neg
      FROM g
    )"""


def summary_sql(source: str, keys: Sequence[str] = ()) -> str:
    """CTEs up to ``s``: the binary summary, with AUC as a pair-counting probability."""
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""{curve_sql(source, keys)},
    m AS (
      SELECT *,
        coalesce(tp / nullif(pos, 0)::DOUBLE, 0) AS tpr,
        coalesce(fp / nullif(neg, 0)::DOUBLE, 0) AS fpr,
        tp / (tp + fp)::DOUBLE AS prec,
        2e0 * tp / (tp + fp + pos) AS f1,
        tp::HUGEINT * neg - fp::HUGEINT * pos AS height
      FROM c
    ),
    l AS (
      SELECT *, lag(prec) OVER ({part} ORDER BY score DESC) AS prec_before,
        lag(tpr) OVER ({part} ORDER BY score DESC) AS tpr_before
      FROM m
    ),
    s AS (
      SELECT {by}max(pos) AS positives, max(neg) AS negatives,
        CASE WHEN max(neg) = 0 THEN 1 ELSE
          coalesce(sum(n * (tp - p / 2e0)) / nullif(max(pos) * max(neg), 0), 0) END AS auc,
        sum((tpr - coalesce(tpr_before, 0)) * (prec + coalesce(prec_before, prec)) / 2) AS auprc,
        arg_min(score, (-f1, score)) AS f1_threshold, max(f1) AS max_f1,
        CASE WHEN max(tpr - fpr) > 0 THEN arg_max(fpr, (height, fp, tp)) ELSE 1 END AS ks_fpr,
        CASE WHEN max(tpr - fpr) > 0 THEN arg_max(tpr, (height, fp, tp)) ELSE 1 END AS ks_tpr,
        greatest(max(tpr - fpr), 0) AS max_ks
      FROM l {group}
    )"""


SUMMARY_DOUBLES = ("auc", "auprc", "f1_threshold", "max_f1", "ks_fpr", "ks_tpr", "max_ks")
SUMMARY_COLUMNS = "positives, negatives, " + ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY_DOUBLES)


def shift_sql(base: str, current: str, keys: Sequence[str] = ()) -> str:
    """CTEs up to ``shift``: exact two-sample distances of relations with feature and x, gaps included as null."""
    by = "".join(f"{k}, " for k in keys)
    own = "".join(f"c.{k}, " for k in keys)
    using = f"({by}feature)"
    return f"""
    b AS ({base}), c AS ({current}),
    bn AS (SELECT feature, count(*) AS rows_base, count(x) AS n_base FROM b GROUP BY feature),
    cn AS (SELECT {by}feature, count(*) AS rows, count(x) AS n FROM c GROUP BY {by}feature),
    bo AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn FROM b WHERE x IS NOT NULL),
    co AS (SELECT {by}feature, x, row_number() OVER (PARTITION BY {by}feature ORDER BY x) AS rn FROM c WHERE x IS NOT NULL),
    parts AS (SELECT unnest(range(1, 257)) AS i),
    bq AS (SELECT feature, i, x FROM bo JOIN bn USING (feature), parts WHERE rn = (i * n_base + 255) // 256),
    cq AS (SELECT {by}feature, i, x FROM co JOIN cn USING {using}, parts WHERE rn = (i * n + 255) // 256),
    grid AS (SELECT {own}feature, x FROM cn AS c JOIN bq USING (feature) UNION SELECT {by}feature, x FROM cq),
    cuts AS (SELECT DISTINCT feature, x FROM bq WHERE i % 16 = 0 AND i < 256),
    ranked AS (
      SELECT {own}c.feature, c.x, (SELECT count(*) FROM bq WHERE bq.feature = c.feature AND bq.x <= c.x) / 256e0 AS f_base,
        (SELECT count(*) FROM cq WHERE cq.feature = c.feature AND cq.x <= c.x {"".join(f"AND cq.{k} = c.{k} " for k in keys)}) / 256e0 AS f
      FROM (SELECT * FROM grid UNION SELECT {own}feature, x FROM cn AS c JOIN cuts USING (feature)) AS c
    ),
    distance AS (SELECT {by}feature, max(abs(f_base - f)) AS ks FROM ranked JOIN bn USING (feature) JOIN cn USING {using}
                 WHERE n > 0 AND n_base > 0 GROUP BY {by}feature),
    ends AS (SELECT {by}feature, x, f_base, f FROM ranked JOIN cuts USING (feature, x)
             UNION ALL SELECT {by}feature, 'infinity'::DOUBLE, CASE WHEN n_base > 0 THEN 1 ELSE 0 END, CASE WHEN n > 0 THEN 1 ELSE 0 END FROM cn JOIN bn USING (feature)),
    cells AS (
      SELECT {by}feature, (f_base - coalesce(lag(f_base) OVER w, 0)) * n_base AS b_rows, (f - coalesce(lag(f) OVER w, 0)) * n AS c_rows
      FROM ends JOIN bn USING (feature) JOIN cn USING {using} WINDOW w AS (PARTITION BY {by}feature ORDER BY x)
      UNION ALL SELECT {by}feature, rows_base - n_base, rows - n FROM cn JOIN bn USING (feature)
    ),
    stability AS (
      SELECT {by}feature, sum((p - q) * ln(p / q)) AS psi FROM (
        SELECT {by}feature, (b_rows + 0.5e0) / (rows_base + 0.5e0 * count(*) OVER w) AS p, (c_rows + 0.5e0) / (rows + 0.5e0 * count(*) OVER w) AS q
        FROM cells JOIN bn USING (feature) JOIN cn USING {using} WINDOW w AS (PARTITION BY {by}feature)) AS z GROUP BY {by}feature
    ),
    shift AS (
      SELECT *, coalesce(ks > ks_limit, false) OR psi > 0.2 AS shifted FROM (
        SELECT {by}feature, n_base, n, 1 - n_base / rows_base::DOUBLE AS gap_base, 1 - n / rows::DOUBLE AS gap, ks,
          CASE WHEN n > 0 AND n_base > 0 THEN sqrt(-0.5e0 * ln(0.005e0)) * sqrt(1 / n::DOUBLE + 1 / n_base::DOUBLE) + 1 / 256e0 END AS ks_limit, psi
        FROM cn JOIN bn USING (feature) LEFT JOIN distance USING {using} JOIN stability USING {using}) AS z
    )"""


SHIFT_DOUBLES = ("gap_base", "gap", "ks", "ks_limit", "psi")
