"""Running values against plain loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbscore.operators.running import Running, rank_rows, running

KINDS = ["sum", "sum_before", "total", "last", "last_before", "next"]


def expected(rows, descending):
    groups = defaultdict(list)
    for key, order, value in rows:
        groups[key].append((order, value))
    wanted = {}
    for key, points in groups.items():
        points.sort(key=lambda p: p[0], reverse=descending)
        total = sum(v for _, v in points if v is not None)
        seen, last = 0, None
        for i, (order, value) in enumerate(points):
            before, last_before = seen, last
            if value is not None:
                seen, last = seen + value, value
            following = next((v for _, v in points[i:] if v is not None), None)
            wanted[key, order] = (seen, before, total, last, last_before, following)
    return wanted


def skewed_rows(seed, n=600):
    """A hot key with half of the rows, a null key, small keys, and gaps in the values."""
    rng = random.Random(seed)
    rows, used = [], set()
    while len(rows) < n:
        key = rng.choices(["hot", None, "a", "b", "c"], [50, 20, 20, 8, 2])[0]
        order = rng.randint(-500, 500) / 4 if rng.random() < 0.5 else rng.randint(0, 10**6)
        if (key, order) not in used:
            used.add((key, order))
            rows.append((key, float(order), rng.choice([None, 1, 2, 3, 10])))
    return rows


@pytest.mark.parametrize("rows_per_slice", [10, 100, 400, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_keyed(spark, rows_per_slice, descending):
    rows = skewed_rows(rows_per_slice)
    df = spark.createDataFrame(rows, "k string, o double, v bigint").repartition(5)
    got = running(df, "o", [Running(k, "v", k) for k in KINDS], ["k"], descending, rows_per_slice)
    found = {(r.k, r.o): tuple(r[k] for k in KINDS) for r in got.collect()}
    assert found == expected(rows, descending)


@pytest.mark.parametrize("rows_per_slice", [7, 100_000])
@pytest.mark.parametrize("descending", [False, True])
def test_without_keys(spark, rows_per_slice, descending):
    rows = [(None, float(i * i % 997 + i / 1000), i % 5 or None) for i in range(300)]
    df = spark.createDataFrame([r[1:] for r in rows], "o double, v bigint")
    got = running(df, "o", [Running(k, "v", k) for k in KINDS], (), descending, rows_per_slice)
    found = {(None, r.o): tuple(r[k] for k in KINDS) for r in got.collect()}
    assert found == expected(rows, descending)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "bigint", "decimal(12,3)"])
def test_order_types(spark, kind):
    start = dt.datetime(2024, 3, 30)
    ids = spark.range(200)
    order = {
        "timestamp_ntz": F.lit(start.isoformat()).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 0.37),
        "timestamp": F.timestamp_millis(F.col("id") * 371),
        "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")),
        "bigint": F.col("id") * 10**15,
        "decimal(12,3)": (F.col("id") / 8).cast("decimal(12,3)"),
    }[kind]
    df = ids.select("id", order.alias("o"), F.lit(1).alias("one"))
    assert df.schema["o"].dataType.simpleString() == kind
    got = running(df, "o", [Running("rank", "one", "sum")], rows_per_slice=20)
    assert all(r["rank"] == r.id + 1 for r in got.collect())


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "k string, o double, v bigint")
    assert running(df, "o", [Running("s", "v", "sum")], ["k"]).collect() == []
    one = spark.createDataFrame([(1.0, 5)], "o double, v bigint")
    row = running(one, "o", [Running("s", "v", "sum"), Running("b", "v", "last_before")], rows_per_slice=1).first()
    assert (row.s, row.b) == (5, None)


def test_extreme_positions(spark):
    values = [float("-inf"), -1.0, 0.0, 2.0, float("inf")]
    df = spark.createDataFrame([(v, 1) for v in values], "o double, one int")
    got = running(df, "o", [Running("rank", "one", "sum")], rows_per_slice=1).orderBy("o").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown kind"):
        Running("x", "y", "median")


@pytest.mark.parametrize("rows_per_slice", [10, 100_000])
def test_rank_of_text(spark, rows_per_slice):
    words = [f"{i * 7919 % 211:03d}" for i in range(211)]
    df = spark.createDataFrame([(w, len(w.strip("0"))) for w in words], "w string, n int").repartition(6)
    got = rank_rows(df, [F.desc("n"), F.asc("w")], rows_per_slice=rows_per_slice).collect()
    wanted = sorted(((-len(w.strip("0")), w) for w in words))
    assert [r.w for r in sorted(got, key=lambda r: r["rank"])] == [w for _, w in wanted]
    assert sorted(r["rank"] for r in got) == list(range(1, 212))


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    import plumbscore.operators.joins as joins

    wide = spark.range(100).select("id", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sha2(
        F.concat(F.col("id").cast("string"), i.cast("string")), 256))).alias("text"))

    def hinted(df):
        return "ResolvedHint" in joins.broadcast_if_small(df, 8)._jdf.queryExecution().analyzed().toString()

    assert hinted(wide)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100_000)
    assert not hinted(wide) and hinted(spark.range(100))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_two_levels_of_slices(spark, monkeypatch, descending, keys):
    import plumbscore.operators.running as module

    caught = []
    slice_rows = module._slice_rows
    monkeypatch.setattr(module, "_slice_rows", lambda *a: caught.append(slice_rows(*a)) or caught[-1])
    rows = skewed_rows(17, 1200)
    if not keys:
        rows = [(None, o + n / 4096, v) for n, (_, o, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, o double, v bigint").repartition(5)
    got = running(df, "o", [Running(k, "v", k) for k in KINDS], keys, descending, rows_per_slice=15, most_slices=3)
    found = {(r.k, r.o): tuple(r[k] for k in KINDS) for r in got.collect()}
    assert found == expected(rows, descending)
    sizes = caught[0].where("__large").groupBy("__slice", "__part").count()
    # As bounded as with enough slices: samples make parts uneven, not large.
    assert sizes.select("__slice").distinct().count() <= 3 < sizes.count() and sizes.agg(F.max("count")).first()[0] <= 60


def test_decimal_sums_are_the_same_in_all_forms(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(i), rng.random() * 10 ** rng.randint(-6, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o double, v double").withColumn("v", F.col("v").cast("decimal(28,18)"))
    forms = [{"rows_per_slice": 100_000}, {"rows_per_slice": 20}, {"rows_per_slice": 7, "most_slices": 4}]
    found = [sorted(running(df, "o", [Running("s", "v", "sum")], ["k"], **f).select("o", "s").collect()) for f in forms]
    assert found[0] == found[1] == found[2]
