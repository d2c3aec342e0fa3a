"""Files, caches, requests, metric tables and saved models."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbscore.operators.aggregates import row_count
from plumbscore.session import materialize, scratch_path, spread, work_dir
from plumbscore.sources.files import (
    LoadSpec,
    TableCache,
    head,
    joined_names,
    list_files,
    load_csv,
    number_rows,
    parse_requests,
    schema_table,
)
from plumbscore.sources.metric_store import all_metrics, append_metrics, latest_metrics, purge_metrics, read_metrics

# A published sample of patient measurements.
PATIENT_COLUMNS = [
    "Pregnancies", "Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI", "DiabetesPedigreeFunction", "Age", "Outcome",
]
PATIENTS = [
    [6, 148, 72, 35, 0, 33.6, 0.627, 50, 1],
    [1, 85, 66, 29, 0, 26.6, 0.351, 31, 0],
    [8, 183, 64, 0, 0, 23.3, 0.672, 32, 1],
    [1, 89, 66, 23, 94, 28.1, 0.167, 21, 0],
    [0, 137, 40, 35, 168, 43.1, 2.288, 33, 1],
    [5, 116, 74, 0, 0, 25.6, 0.201, 30, 0],
    [3, 78, 50, 32, 88, 31.0, 0.248, 26, 1],
    [10, 115, 0, 0, 0, 35.3, 0.134, 29, 0],
    [2, 197, 70, 45, 543, 30.5, 0.158, 53, 1],
    [8, 125, 96, 0, 0, 0.0, 0.232, 54, 1],
]


@pytest.fixture
def patients(tmp_path):
    path = tmp_path / "patients.csv"
    lines = [PATIENT_COLUMNS, *PATIENTS]
    path.write_text("\n".join(",".join(map(str, line)) for line in lines) + "\n")
    return str(path)


def test_load_with_header_and_types(spark, patients):
    df = load_csv(spark, LoadSpec(patients, True, ",", True))
    types = ["int"] * 5 + ["double"] * 2 + ["int"] * 2
    got = [tuple(r) for r in schema_table(df).orderBy("pos").collect()]
    assert got == [(i, n, t, True) for i, (n, t) in enumerate(zip(PATIENT_COLUMNS, types))]
    assert df.columns == PATIENT_COLUMNS
    assert sorted(list(r) for r in head(df).collect()) == sorted(PATIENTS)
    assert row_count(df).first().linecount == 10
    assert [r.Glucose for r in head(df, 2, ["Glucose"]).collect()] == [78, 85]


def test_load_defaults_to_text_without_header(spark, patients):
    df = load_csv(spark, LoadSpec(patients))
    assert df.columns == [f"_c{i}" for i in range(9)] and df.count() == 11
    assert {f.dataType.simpleString() for f in df.schema} == {"string"}


def test_load_spec_flags():
    assert LoadSpec("x", True, ",", "FALSE") == LoadSpec("x", "true", ",", False)
    assert LoadSpec.from_json('{"filepath": "x", "sep": "\\t", "other": 1}') == LoadSpec("x", sep="\t")
    with pytest.raises(TypeError):
        LoadSpec.from_json("{}")
    with pytest.raises(ValueError, match="hasHeader"):
        LoadSpec("x", "yes")


def test_cache_is_bounded_and_released(spark, patients):
    cache = TableCache(spark)
    first = cache.load(LoadSpec(patients))
    assert cache.load(LoadSpec(patients)) is first and first.is_cached
    second = cache.load(LoadSpec(patients, True))
    assert not first.is_cached and second.is_cached
    cache.release()
    assert not second.is_cached
    cache.release(LoadSpec("unknown"))


def test_changed_files_are_read_again(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("x\n1\n")
    spec, cache = LoadSpec(str(tmp_path / "t"), True), TableCache(spark)
    first = cache.load(spec)
    assert first.count() == 1 and cache.load(spec) is first
    (tmp_path / "t" / "a.csv").write_text("x\n1\n2\n")
    second = cache.load(spec)
    assert second.count() == 2 and second.is_cached and cache.load(spec) is second
    (tmp_path / "t" / "b.csv").write_text("x\n3\n")
    assert cache.load(spec).count() == 3
    cache.release()


def test_listing(spark, tmp_path):
    for name in ("b.csv", "a.csv", "c.txt"):
        (tmp_path / name).write_text("x" * len(name))
    files = list_files(spark, str(tmp_path))
    assert {(r.name, r.length) for r in files.collect()} == {("a.csv", 5), ("b.csv", 5), ("c.txt", 5)}
    assert joined_names(list_files(spark, str(tmp_path), pattern="*.csv")).first().names == "a.csv,b.csv"


def test_numbers(spark):
    assert [r.id for r in number_rows(spark, 3).collect()] == [1, 2, 3]


def test_requests(spark):
    bodies = ['{"filepath": "/a", "sep": "\\t", "hasHeader": "True"}', '{"sep": ";"}', "no json", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = [tuple(r)[2:] for r in parse_requests(df, "body").orderBy("id").collect()]
    nothing = (None, "false", ",", "false", False)
    assert got == [("/a", "true", "\t", "false", True), (None, "false", ";", "false", False), nothing, nothing]


def metric_rows(spark, numbers, model="m"):
    day = dt.datetime(2024, 1, 1)
    rows = [(n, day, model, "auc", n / 10) for n in numbers]
    return spark.createDataFrame(rows, "seq bigint, date timestamp_ntz, model string, metric string, value double")


def test_metric_store(spark):
    root = scratch_path(spark, "test-metrics")
    assert all_metrics(spark, root, "champion").count() == 0
    for _ in range(2):
        append_metrics(metric_rows(spark, [10, 9]), root, "champion", 1)
    append_metrics(metric_rows(spark, [100, 2]), root, "champion", 2)
    append_metrics(metric_rows(spark, [5]), root, "multiarm", 1)
    assert [r.seq for r in read_metrics(spark, root, "champion").collect()] == [2, 9, 10, 100]
    assert [r.seq for r in read_metrics(spark, root, "champion", 2).collect()] == [10, 100]
    purge_metrics(spark, root, "champion")
    assert all_metrics(spark, root, "champion").count() == 0 and all_metrics(spark, root, "multiarm").count() == 1
    append_metrics(metric_rows(spark, [7]), root, "champion", 3)
    assert [r.seq for r in all_metrics(spark, root, "champion").collect()] == [7]
    with pytest.raises(ValueError, match="unknown mode"):
        purge_metrics(spark, root, "other")


def test_text_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([("10",), ("9",), ("100",)], "id string")
    assert [r.id for r in latest_metrics(df, "id", 2).collect()] == ["10", "100"]
    assert [r.id for r in latest_metrics(df, "id").collect()] == ["9", "10", "100"]


def test_metrics_are_not_cut(spark):
    root = scratch_path(spark, "test-metrics")
    for batch in range(3):
        append_metrics(metric_rows(spark, [batch] * 600), root, "champion", batch)
    assert read_metrics(spark, root, "champion").count() == 1800
    assert {r.seq for r in read_metrics(spark, root, "champion", 2).collect()} == {1, 2}


def test_materialize_and_folder(spark):
    df = materialize(spark.range(5))
    assert df.count() == 5
    assert df.inputFiles()[0].replace("file:", "").lstrip("/").startswith(work_dir(spark).lstrip("/"))


def test_spread(spark):
    for given in (1, 8):
        for keys in ((), ("id",)):
            parts = spread(spark.range(100, numPartitions=given), *keys, partitions=6)
            assert parts.select(F.spark_partition_id()).distinct().count() == 6
