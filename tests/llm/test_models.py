"""Quality and toxicity models: held-out accuracy and edge cases."""

import random

import numpy as np
import pytest

from plumbscore.llm import quality, toxicity
from plumbscore.llm.registered import table

SCHEMA = "doc_id long, text string, score string, x string"
EDGES = [(1, None), (2, ""), (3, "   \n"), (None, "a b"), (4, "!"), (4, "!"), (5, "word " * 50_000), (6, "\x00\ud7ff é")]


def area(scores, y):
    order = np.argsort(np.argsort(scores)) + 1
    p, n = y.sum(), (1 - y).sum()
    return (order[y == 1].sum() - p * (p + 1) / 2) / (p * n)


@pytest.mark.parametrize("name, label, parts, out", [("op3_quality_additive_model", "quality", 5, 0), ("op7_toxicity_weak_supervision", "toxic", 3, 1)])
def test_held_out(spark, name, label, parts, out):
    import zlib

    from plumbscore.llm import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, folder).toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    assert rows["held_out"].tolist() == [zlib.crc32(str(i).encode()) % parts == out for i in rows["doc_id"]]
    assert ((rows["score"] >= (0.3 if label == "quality" else 0.7)).astype(int) == rows["predicted"]).all()
    known = rows.merge(table(spark, folder, "labels").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert area(held["score"].to_numpy(), held[label].to_numpy()) > 0.85
    assert (held["predicted"] == held[label]).mean() > 0.9


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    alone = quality.fit(x, y, how_many_pairs=0)
    pairs = quality.fit(x, y)
    assert {0, 1} == set(pairs.pairs[0][:2])
    assert ((pairs.scores(x) > 0.5) == y).mean() > 0.9 > ((alone.scores(x) > 0.5) == y).mean()


def test_additive_model_without_labels():
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).scores(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert quality.fit(np.ones((5, 2)), np.ones(5)).scores(np.ones((1, 2)))[0] > 0.9


def test_trees():
    grad, hess = np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4)
    assert quality._tree(grad, hess, 2, 0.0).tolist() == [1, 1, -1, -1]
    values, gain = quality._grid_tree(np.array([[1.0, -1.0], [-1.0, 1.0]]), np.ones((2, 2)), 0.0)
    assert values.tolist() == [[1, -1], [-1, 1]] and gain == pytest.approx(4)


def test_features_are_finite_and_clashes_do_not_matter(spark):
    for _, text in EDGES:
        values = quality.features(text or "")
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in EDGES], SCHEMA)
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (77, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(EDGES)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.drop_toxic(docs, labels).count() == len(EDGES)
    for drop in (quality.drop_low_quality, toxicity.drop_toxic):
        assert drop(docs.limit(0), labels).count() == 0
        assert drop(docs, labels.limit(0)).count() == len(EDGES)


def test_markers_are_found_and_copies_give_none(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit") for b in ("um", "em", "or", "an", "es")]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            text[5], text[30] = f"zorg{rng.choice(words)}", f"zorg{rng.choice(words)}"
        rows.append((int(i % 3 == 0), " ".join(text)))
    rows += [(1, rows[0][1] + " rarely seen unique tokens")] * 20
    found = toxicity.find_markers(spark.createDataFrame(rows, "toxic int, text string"), "toxic")
    assert found[0][0].startswith("zorg") and len(found) == 1


def test_label_model_weighs_copied_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < 0.85, y, ~y).astype(int) * 2 - 1 for _ in range(4)], axis=1)
    copied = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    model = toxicity.fit_label_model(copied, 0.3)
    assert model.weights[0] < 0.5 < model.weights[1]
    assert ((model.posterior(copied) > 0.5) == y).mean() > 0.88
    assert toxicity.fit_label_model(np.zeros((0, 3), dtype=int)).posterior(np.zeros((1, 3), dtype=int))[0] == pytest.approx(0.1)


def test_linear_classifier_keeps_signs():
    x = np.array([[0.0, 1.0], [1.0, 0.0], [2.0, 1.0], [0.0, 0.0]] * 50)
    model = toxicity.fit_linear(x, (x[:, 0] > 0).astype(float))
    assert (model.weights >= 0).all() and model.scores(x[1:2])[0] > 0.9 > 0.1 > model.scores(x[3:4])[0]
