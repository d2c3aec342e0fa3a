"""Cleaning, labels, splits, sampling and text."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbscore.functions import (
    fill_numbers,
    hash_uniform,
    indicator,
    join_text,
    normalise_weights,
    parse_number,
    parse_time,
    result_json,
    row_text,
    split_text,
    weight_sum,
)
from plumbscore.operators.aggregates import indicator_rate, series_extent, series_top, wide_metrics
from plumbscore.operators.features import hash_split, label_table, prepare, random_split
from plumbscore.operators.sampling import assign, equal_weights, period_sample, traffic_models

NAN = float("nan")


def test_fill_touches_numbers_only(spark):
    df = spark.createDataFrame([(None, NAN, None, None), (1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    assert fill_numbers(df).first() == (0, 0.0, None, None)
    assert fill_numbers(df, ["d"]).first()[:2] == (None, 0.0)


def test_labels_by_frequency_then_text(spark):
    df = spark.createDataFrame([(v,) for v in [9, 9, 10, 10, 3, 3, 3, None]], "t int")
    got = {r.value: (r.label, r.n) for r in label_table(df, "t").collect()}
    assert got == {"3": (0.0, 3), "10": (1.0, 2), "9": (2.0, 2)}
    prepared = prepare(df.withColumn("x", F.lit(1.0)), "t")
    assert prepared.labels == ["3", "10", "9"]
    assert prepared.rows_without_target.first()[0] == 1
    assert prepared.data.count() == 7


def test_prepare_fills_features_but_not_targets(spark):
    df = spark.createDataFrame([(None, 5, "x"), (NAN, None, "y"), (3.0, 7, "x"), (1.0, 1, None)], "a double, b int, t string")
    data = prepare(df, "t").data.select(vector_to_array("features").alias("f"), "label").collect()
    assert sorted((tuple(r.f), r.label) for r in data) == [((0.0, 0.0), 1.0), ((0.0, 5.0), 0.0), ((3.0, 7.0), 0.0)]


def test_prepare_takes_named_columns_and_refuses_text(spark):
    df = spark.createDataFrame([(1.0, "x", dt.date(2024, 1, 1), 0)], "a double, s string, d date, t int")
    assert prepare(df, "t", ["a", "t"]).features == ["a"]
    with pytest.raises(ValueError, match=r"s \(string\), d \(date\)"):
        prepare(df, "t")


def test_hash_is_uniform_and_depends_on_salt(spark):
    ids = spark.range(20_000)
    found = ids.select(hash_uniform("id", salt="a").alias("a"), hash_uniform("id", salt="b").alias("b"))
    row = found.agg(F.min("a"), F.max("a"), F.avg("a"), F.corr("a", "b")).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.01 and abs(row[3]) < 0.03


def test_hash_split_is_disjoint_complete_and_repeatable(spark):
    df = spark.range(5000).withColumn("key", F.when(F.col("id") % 100 != 0, F.col("id")))
    for weights in ([0.8, 0.2], [2, 1, 1], [0, 1], [1, 0]):
        parts = [{r.id for r in p.collect()} for p in hash_split(df, ["id", "key"], weights)]
        assert sum(map(len, parts)) == 5000 and len(set().union(*parts)) == 5000
        for part, weight in zip(parts, weights):
            assert abs(len(part) / 5000 - weight / sum(weights)) < 0.03
    again = hash_split(df.repartition(7), ["id", "key"])[1]
    assert {r.id for r in again.collect()} == {r.id for r in hash_split(df, ["id", "key"])[1].collect()}
    assert sum(p.count() for p in hash_split(df, "key")) == 5000


def test_random_split(spark):
    parts = random_split(spark.range(1000), seed=4)
    assert sum(p.count() for p in parts) == 1000


@pytest.mark.parametrize("weights", [[-1, 2], [0, 0], [], ["x"], [float("nan")], [float("inf")]])
def test_bad_weights(weights):
    with pytest.raises(ValueError):
        normalise_weights(weights)


def test_weights_are_normalised():
    assert equal_weights(["a", "b", "c"]) == [0.33, 0.33, 0.33]
    assert sum(normalise_weights(["0.33", "0.33", "0.33"])) == pytest.approx(1)


def test_assignment_shares(spark):
    models = traffic_models(["a", "kmeans", "b", "c"])
    assert models == ["a", "b", "c"]
    counts = {r.model: r["count"] for r in assign(spark.range(9000), "id", models, [0.33] * 3).groupBy("model").count().collect()}
    assert sum(counts.values()) == 9000 and all(abs(n - 3000) < 200 for n in counts.values())
    only = assign(spark.range(100), "id", models, [0, 1, 0]).select("model").distinct().collect()
    assert [r.model for r in only] == ["b"]
    with pytest.raises(ValueError):
        assign(spark.range(1), "id", models, [1])


def test_period_samples_differ(spark):
    a, b = ({r.id for r in period_sample(spark.range(4000), "id", p, 0.5).collect()} for p in (1, 2))
    assert abs(len(a) - 2000) < 150 and abs(len(a & b) - 1000) < 150


def test_indicator_counts_null_as_no(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert [r[0] for r in df.select(indicator(F.col("x") < 3)).collect()] == [1, 0, 0]
    assert indicator_rate(df, F.col("x") < 3, 4.0).first() == (1, 3, pytest.approx(4 / 3))


def test_text_functions(spark):
    df = spark.createDataFrame([("a, b,,c|d", 'quote " and\nnewline', None, 1.5)], "s string, j string, n int, d double")
    row = df.select(
        split_text("s").alias("items"),
        split_text("s", "|").alias("bars"),
        row_text(["s", "n", "d"]).alias("text"),
        result_json(["j", "n", "d"]).alias("json"),
    ).withColumn("joined", join_text("items")).first()
    assert row["items"] == ["a", "b", "c|d"] and row.bars == ["a, b,,c", "d"] and row.joined == "a,b,c|d"
    assert row.text == "[a, b,,c|d,null,1.5]"
    assert json.loads(row.json) == {"j": 'quote " and\nnewline', "n": None, "d": 1.5}


def test_parsing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("2024-02-30",), ("2024-02-03",)], "s string")
    assert [r[0] for r in df.select(parse_number("s")).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(parse_time("s")).collect()][2:] == [None, dt.datetime(2024, 2, 3)]
    sums = spark.createDataFrame([("0.33, 0.33,0.34",), ("1,x",)], "w string").select(weight_sum("w")).collect()
    assert sums[0][0] == pytest.approx(1.0) and sums[1][0] is None


def test_series(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (3, "a", 4.0), (3, "c", 9.0)], "t int, m string, v double")
    assert series_extent(df, "t").first() == (1, 3)
    wide = wide_metrics(df, "t", "m", "v", ["a", "b"])
    assert [tuple(r) for r in wide.orderBy("t").collect()] == [(1, 2.0, None), (3, 4.0, None)]
    assert series_top(wide, ["a", "b"]).first()[0] == pytest.approx(4.4)


def test_missing_truth_values_become_zero(spark):
    df = spark.createDataFrame([(True, 1.0, "a"), (None, None, "a"), (False, 3.0, "b")], "flag boolean, x double, target string")
    made = prepare(df, "target").data.select("features").collect()
    assert sorted(tuple(r.features) for r in made) == [(0.0, 0.0), (0.0, 3.0), (1.0, 1.0)]


def test_a_varying_number_is_no_class(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") / 7).alias("target"))
    with pytest.raises(ValueError, match="more than 50 distinct"):
        prepare(df, "target", ["x"], max_labels=50)
    assert prepare(df, "target", ["x"], index=False, max_labels=50).data.columns == ["x", "target", "features"]


def test_no_rows_with_a_target(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, target string")
    made = prepare(df, "target", ["x"])
    assert made.labels == [] and made.data.count() == 0
    assert made.rows_without_target.first()[0] == 1
