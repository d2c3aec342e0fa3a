"""Window counts by batch: replays, late rows, open windows, compaction that may be interrupted."""

from __future__ import annotations

import os
import shutil
from collections import Counter
from datetime import datetime, timedelta

import pytest

from plumbscore.streaming.windows import WindowStore

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, model string, score double, y double"


def rows(*found):
    return [(START + timedelta(hours=h) if h is not None else None, m, s, y) for h, m, s, y in found]


BATCHES = [
    rows((1, "a", 0.5, 1.0), (2, "a", 0.4, 0.0), (30, "b", 0.2, 1.0)),
    rows((3, "a", 0.9, 1.0), (47, "a", 0.1, 0.0), (None, "a", 0.3, 1.0)),
    rows((5, "b", 0.9, 1.0), (31, "b", 0.7, 0.0), (75, "a", 0.6, 1.0)),
    rows((40, "b", 0.7, 0.0), (76, None, 0.6, 1.0)),
]


@pytest.fixture
def store(tmp_path):
    return WindowStore(str(tmp_path / "windows"), "ts", "1 day", "1 hour")


def batch(spark, n):
    return spark.createDataFrame(BATCHES[n], SCHEMA)


def plain():
    counts, late, high = Counter(), Counter(), None
    for part in BATCHES:
        closed = high - timedelta(hours=1) if high else None
        for ts, model, score, y in part:
            if ts is None:
                continue
            day = datetime(ts.year, ts.month, ts.day)
            if closed and day + timedelta(days=1) <= closed:
                late[day, model] += 1
            else:
                counts[day, model, score] += 1
        high = max([t for t, *_ in part if t] + ([high] if high else []))
    return counts, late


def summed(spark, store):
    found = Counter()
    for r in store.counts(spark).collect():
        found[r["date"], r["model"], r["score"]] += r["p"] + r["n"]
    return found


def test_counts_late_rows_and_replays(spark, store):
    for n in range(len(BATCHES)):
        store.process(batch(spark, n), n)
    for again in (1, 3, 0):
        store.process(batch(spark, again), again)
        counts, late = plain()
        assert summed(spark, store) == counts
        assert {(r["date"], r["model"]): r["late"] for r in store.late_rows(spark).collect()} == late
    lines = {r["batch"]: r for r in store.ledger(spark).collect()}
    assert [(lines[n]["rows"], lines[n]["late"], lines[n]["untimed"]) for n in range(4)] == [(3, 0, 0), (3, 1, 1), (3, 1, 0), (2, 1, 0)]
    assert lines[0]["closed"] is None and lines[1]["high"] == START + timedelta(hours=47)
    found = {(r["date"], r["model"]): r for r in store.metrics(spark).collect()}
    assert found[START, "a"]["positives"] == 1 and not found[START, "a"]["is_open"] and found[START, "a"]["late"] == 1
    assert found[START, "b"]["positives"] is None and found[START, "b"]["late"] == 1
    assert found[START + timedelta(days=3), "a"]["is_open"] and found[START + timedelta(days=1), "b"]["late"] == 1


def test_a_gap_in_batches_keeps_the_high_mark(spark, store):
    store.process(batch(spark, 2), 0)
    store.process(batch(spark, 0).limit(0), 1)
    store.process(batch(spark, 0), 4)
    assert store.ledger(spark).where("batch = 4").first()["late"] == 3


def test_compaction_can_be_interrupted(spark, store):
    for n in range(len(BATCHES)):
        store.process(batch(spark, n), n)
    wanted = summed(spark, store)
    store.compact(spark, 2)
    before = store.counts(spark)
    assert summed(spark, store) == wanted and len(os.listdir(os.path.join(store.path, "counts"))) == 4
    # A sum that was cut off has no marker: it does not count, and the next one replaces it.
    store.compact(spark, 3)
    half = os.path.join(store.path, "base", "upto=3")
    os.remove(os.path.join(half, "_SUCCESS"))
    assert summed(spark, store) == wanted
    store.compact(spark, 3)
    assert summed(spark, store) == wanted
    # Crashed after the marker, before old folders went: what is summed is not read beside the sum.
    assert sorted(x for x in os.listdir(os.path.join(store.path, "base"))) == ["upto=2", "upto=3"]
    # Who listed the folders before these calls still reads them.
    assert sum(r["p"] + r["n"] for r in before.collect()) == sum(wanted.values())
    store.compact(spark, 4)
    assert sorted(x for x in os.listdir(os.path.join(store.path, "base"))) == ["upto=3", "upto=4"]
    assert summed(spark, store) == wanted
    store.compact(spark, 4)
    assert summed(spark, store) == wanted


def test_empty_store(spark, store):
    assert store.counts(spark).count() == store.late_rows(spark).count() == store.metrics(spark).count() == 0
    store.process(batch(spark, 0).limit(0), 0)
    assert store.metrics(spark).count() == 0 and store.ledger(spark).first()["rows"] == 0
    shutil.rmtree(store.path)
