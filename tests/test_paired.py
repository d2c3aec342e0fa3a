"""The paired test of AUCs against pair counting and repeated draws."""

from __future__ import annotations

import math
import random
import statistics
from itertools import combinations

import pytest

from plumbscore.operators.paired import compare_aucs

SCHEMA = "g string, id long, model string, score double, y double"


def plain(rows, models):
    """``rows`` of one group: id -> (y, {model: score})."""
    whole = {i: r for i, r in rows.items() if all(m in r[1] for m in models)}
    pos, neg = ([i for i, (y, _) in whole.items() if (y > 0.5) == side] for side in (True, False))

    def share(values):
        return sum(values) / len(values)

    def placed(m):
        s = {i: r[1][m] for i, r in whole.items()}
        v = {i: share([(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for j in neg]) for i in pos}
        w = {j: share([(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in pos]) for j in neg}
        return v, w

    found = {}
    for a, b in combinations(models, 2):
        (va, wa), (vb, wb) = placed(a), placed(b)
        d, e = [va[i] - vb[i] for i in pos], [wa[j] - wb[j] for j in neg]
        error = math.sqrt(statistics.variance(d) / len(d) + statistics.variance(e) / len(e))
        found[a, b] = (len(whole), sum(d) / len(d), sum(d) / len(d) / error)
    return found


@pytest.mark.parametrize("rows_per_slice", [20, 100_000])
def test_equals_pair_counting_with_ties_and_gaps(spark, rows_per_slice):
    rng = random.Random(8)
    models, groups, lines = ["a", "b", "c"], {}, []
    for g, n in (("x", 300), ("y", 60)):
        rows = groups.setdefault(g, {})
        for i in range(n):
            y = float(rng.random() < 0.4)
            scores = {m: round(rng.gauss(y * w, 1), 1) for m, w in zip(models, (0.2, 0.9, 0.2), strict=True) if rng.random() > 0.05}
            rows[i] = (y, scores)
            lines += [(g, i, m, s, y) for m, s in scores.items()]
    lines += [("x", 900, m, float("nan") if m == "a" else 0.5, 1.0) for m in models]
    lines += [("x", 901, m, 0.5, None) for m in models] + [("only", 1, "a", 0.1, 1.0)]
    found = compare_aucs(spark.createDataFrame(lines, SCHEMA).repartition(4), "id", models, ["g"], rows_per_slice=rows_per_slice).collect()
    got = {(r["g"], r["model_a"], r["model_b"]): (r["rows"], r["difference"], r["z"]) for r in found}
    wanted = {(g, *pair): v for g, rows in groups.items() for pair, v in plain(rows, models).items()}
    assert got.keys() == wanted.keys()
    for k, v in wanted.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    assert all(r["significant"] == (abs(r["z"]) > 1.96) for r in found)


def test_no_variance_gives_no_verdict(spark):
    same = [("x", i, m, float(i % 7), float(i % 2)) for i in range(40) for m in "ab"]
    one = [("one", i, m, float(i + (m == "b")), 1.0) for i in range(5) for m in "ab"]
    rows = {(r["g"]): r for r in compare_aucs(spark.createDataFrame(same + one, SCHEMA), "id", ["a", "b"], ["g"]).collect()}
    assert rows["x"]["difference"] == 0 and rows["x"]["z"] is None and rows["x"]["significant"] is None
    assert rows["one"]["rows"] == 5 and rows["one"]["z"] is None
    assert compare_aucs(spark.createDataFrame([], SCHEMA), "id", ["a", "b"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        compare_aucs(spark.createDataFrame([], SCHEMA), "id", ["a", "a"])


def test_false_alarms_are_as_rare_as_stated(spark):
    rng = random.Random(9)
    lines = []
    for g in range(150):
        for i in range(80):
            y = float(i % 2)
            shared = rng.gauss(y, 1)
            lines += [(str(g), i, m, shared + rng.gauss(0, 0.7), y) for m in "ab"]
    found = compare_aucs(spark.createDataFrame(lines, SCHEMA), "id", ["a", "b"], ["g"])
    assert found.where("significant").count() <= 17
