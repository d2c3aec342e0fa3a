"""Input shift by sketches: exact on small data, bounded beyond, and flags that mean something."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from plumbscore.operators.drift import POINTS, input_shift, input_sketches, merge_sketches, rank_error
from plumbscore.sources.model_store import load_profile, profile_path, save_profile


def frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def distance(a, b):
    a, b = sorted(a), sorted(b)
    return max(abs(bisect.bisect_right(a, x) / len(a) - bisect.bisect_right(b, x) / len(b)) for x in a + b)


def test_distance_is_within_its_error(spark):
    rng = random.Random(5)
    base, moved = [rng.gauss(0, 1) for _ in range(20_000)], [rng.gauss(0.3, 1.2) for _ in range(15_000)]
    for k in (64, 65_535):
        sketches = [input_sketches(frame(spark, v).repartition(7), ["x"], k=k) for v in (base, moved)]
        row = input_shift(*sketches).first()
        allowed = 1 / POINTS + (2 * rank_error(k) if k == 64 else 0)
        assert abs(row["ks"] - distance(base, moved)) <= allowed and row["shifted"]


def test_shifted_and_unshifted_features(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.gauss(0, 1), rng.choice((1.0, 2.0)), 5.0) for _ in range(6000)]
    names = ["same", "moved", "gaps", "constant"]
    later = [(rng.random(), rng.gauss(0.5, 1), None if rng.random() < 0.5 else rng.choice((1.0, 2.0)), 5.0) for _ in range(4000)]
    base, now = (spark.createDataFrame(r, ", ".join(f"{n} double" for n in names)) for r in (rows, later))
    found = {r["feature"]: r for r in input_shift(input_sketches(base, names), input_sketches(now, names)).collect()}
    assert {f: r["shifted"] for f, r in found.items()} == {"same": False, "moved": True, "gaps": True, "constant": False}
    assert found["gaps"]["gap"] == pytest.approx(0.5, abs=0.05) and found["gaps"]["ks"] < found["gaps"]["ks_limit"]
    assert found["constant"]["ks"] == 0 and found["constant"]["psi"] < 0.01


def test_false_alarms_are_rare(spark):
    rng = random.Random(7)
    base = input_sketches(frame(spark, [rng.random() for _ in range(4000)]), ["x"])
    rows = [(g, rng.random()) for g in range(200) for _ in range(300)]
    now = input_sketches(spark.createDataFrame(rows, "g int, x double"), ["x"], ["g"])
    assert input_shift(base, now, ["g"]).where("shifted").count() <= 6


def test_merged_sketches_are_those_of_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 10).alias("day"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("x"))
    base = input_sketches(rows.where("x < 800"), ["x"], k=8192)
    whole = input_shift(base, input_sketches(rows, ["x"], k=8192)).first()
    merged = input_shift(base, merge_sketches(input_sketches(rows, ["x"], ["day"], 8192))).first()
    assert tuple(whole) == tuple(merged) and whole["n"] == 5000


def test_sides_without_values(spark):
    some, none = frame(spark, [1, 2, 3, None, float("nan")] * 40), frame(spark, [None] * 100)
    full, empty = input_sketches(some, ["x"]), input_sketches(none, ["x"])
    assert full.first()["rows"] == 200 and full.first()["n"] == 120
    for base, now in ((full, empty), (empty, full)):
        row = input_shift(base, now).first()
        assert row["ks"] is None and row["ks_limit"] is None and row["shifted"]
    assert not input_shift(empty, empty).first()["shifted"]
    assert input_shift(full, input_sketches(some.limit(0).withColumn("g", F.lit(1)), ["x"], ["g"]), ["g"]).count() == 0
    assert input_shift(full, input_sketches(frame(spark, [1], "other"), ["other"])).count() == 0


def test_profile_is_kept_with_the_model(spark, tmp_path):
    made = input_sketches(frame(spark, range(100)), ["x"])
    path = profile_path(str(tmp_path), "forest")
    save_profile(made, path)
    assert path.endswith("profiles/forest") and load_profile(spark, path).collect() == made.collect()
    save_profile(input_sketches(frame(spark, range(50)), ["x"]), path)
    assert load_profile(spark, path).first()["n"] == 50
