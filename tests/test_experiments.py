"""A/B tests read every window, and bandits on partial feedback."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from plumbscore.plans.experiments import ab_sequential, logged_gains, partial_splits, policy_values

RATES = "date int, model string, n long, conversions long"


def plain(counts, models, tau):
    """The same p-values, window by window."""
    seen, best, found = {m: [0, 0] for m in models}, {}, {}
    for day in sorted({d for d, *_ in counts}):
        for d, m, n, c in counts:
            if d == day and m in seen:
                seen[m] = [seen[m][0] + n, seen[m][1] + c]
        for a, b in itertools.combinations(models, 2):
            (n1, c1), (n2, c2) = seen[a], seen[b]
            ratio = -math.inf
            if n1 and n2 and 0 < c1 + c2 < n1 + n2:
                q = (c1 + c2) / (n1 + n2)
                v = q * (1 - q) * (1 / n1 + 1 / n2)
                ratio = math.log(v / (v + tau**2)) / 2 + tau**2 * (c1 / n1 - c2 / n2) ** 2 / (2 * v * (v + tau**2))
            best[a, b] = max(best.get((a, b), 0.0), ratio)
        p = sorted((math.exp(-r), pair) for pair, r in best.items())
        held = 0.0
        for i, (value, pair) in enumerate(p):
            held = max(held, min(1.0, (len(p) - i) * value))
            found[(day, *pair)] = (value, held)
    return found


def test_sequential_against_plain_steps(spark):
    rng = random.Random(3)
    counts = [(d, m, 200, sum(rng.random() < r for _ in range(200))) for d in range(12) for m, r in (("a", 0.1), ("b", 0.25), ("c", 0.12))]
    counts = [c for c in counts if (c[0], c[1]) not in ((0, "a"), (5, "b"))] + [(3, "other", 5, 5), (4, None, 1, 1)]
    models = ["a", "b", "c", "none"]
    rows = ab_sequential(spark.createDataFrame(counts, RATES), models, tau=0.05).collect()
    wanted = plain(counts, models, 0.05)
    assert {(r.date, r.model_a, r.model_b) for r in rows} == set(wanted)
    for r in rows:
        assert (r.p, r.adjusted) == pytest.approx(wanted[r.date, r.model_a, r.model_b])
        assert r.significant == (r.adjusted <= 0.05)
    last = {(r.model_a, r.model_b): r for r in rows if r.date == 11}
    assert last["a", "b"].significant and not last["a", "c"].significant
    assert last["a", "none"].p == 1 and last["a", "none"].difference is None
    assert ab_sequential(spark.createDataFrame([], RATES), models).count() == 0


def test_daily_looks_rarely_raise_false_alarms(spark):
    """A hundred tests without a difference, each read on thirty days; one of twenty may raise an alarm at any time."""
    rng = random.Random(4)
    rows = [(d, t, m, 100, sum(rng.random() < 0.3 for _ in range(100))) for d in range(30) for t in range(100) for m in "ab"]
    rates = spark.createDataFrame(rows, "date int, test int, model string, n long, conversions long")
    found = ab_sequential(rates, ["a", "b"], tau=0.05, keys=["test"])
    assert found.count() == 3000
    assert found.where("significant").select("test").distinct().count() <= 10


def test_partial_feedback(spark):
    log = [(1, "a", 1.0, 0.5), (1, "a", 0.0, 0.5), (1, "b", 1.0, 0.25), (1, "x", 1.0, 0.25), (1, "b", 1.0, 0.0), (None, "a", 1.0, 0.5)]
    log += [(2, "a", None, 0.5), (2, "a", 1.0, 0.5), (3, "b", 0.0, 0.25)]
    frame = spark.createDataFrame(log, "date int, model string, r double, p double")
    gains = logged_gains(frame, ["a", "b"], "r", "p")
    found = {(r.date, r.model): (r.n, r.paid, r.weight, r.gain) for r in gains.collect()}
    assert found[1, "a"] == (2, 2.0, 4.0, pytest.approx(2 / 3)) and found[1, "b"] == (1, 4.0, 4.0, pytest.approx(4 / 3))
    assert found[2, "a"] == (2, 2.0, 4.0, 1.0) and found[2, "b"] == (0, 0.0, 0.0, 0.0) and found[3, "a"][3] == 0
    splits = partial_splits(gains, eta=2.0, mix=0.2)
    share = {(r.date, r.model): r.split for r in splits.collect()}
    assert share[1, "a"] == share[1, "b"] == pytest.approx(0.5)
    assert share[2, "b"] == pytest.approx(0.8 / (1 + math.exp(-4 / 3)) + 0.1) and share[2, "a"] + share[2, "b"] == pytest.approx(1)
    value = {r.date: r for r in policy_values(splits).collect()}
    assert value[1].value == pytest.approx((0.5 * 2 + 0.5 * 4) / 3) and value[1].scaled_value == pytest.approx(3 / 4)
    assert value[2].value == pytest.approx(share[2, "a"]) and value[2].scaled_value == pytest.approx(0.5) and value[2].n == 2
    assert policy_values(partial_splits(logged_gains(frame.limit(0), ["a", "b"], "r", "p"))).count() == 0


def test_estimates_are_unbiased(spark):
    """The weighted log tells the rate of every model, though each row shows one."""
    rng = random.Random(5)
    true, chance = {"a": 0.2, "b": 0.6, "c": 0.4}, {"a": 0.7, "b": 0.1, "c": 0.2}
    names = rng.choices(list(chance), list(chance.values()), k=20_000)
    log = spark.createDataFrame([(1, m, float(rng.random() < true[m]), chance[m]) for m in names], "date int, model string, r double, p double")
    found = {r.model: r.gain for r in logged_gains(log, list(true), "r", "p").collect()}
    assert all(abs(found[m] - true[m]) < 0.05 for m in true)
