"""Class n-grams against plain versions."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from plumbscore.llm import brown
from plumbscore.llm.registered import crc_part, table

SCHEMA = "doc_id long, text string, out boolean, score string, row string, types string"


def made():
    rng = np.random.default_rng(2)
    nouns, verbs, rare = ["cat", "dog", "Cow", "é"], ["runs", "eats", "sits"], [f"x{i}y" for i in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.integers(0, 20)):
            words += [rng.choice(nouns), rng.choice(verbs)] + ([rng.choice(rare)] if rng.random() < 0.2 else [])
        rows.append((i, " ".join(words), i % 10 == 0))
    rows += [(900, None, False), (901, "", True), (902, " \n", False), (5, "cat runs", True), (5, "cat runs", True), (None, "CAT\tnever-seen\x00 é", True), (903, "cat eats " * 30_000, False)]
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    caught = {}
    cluster, read = brown.cluster, brown.read_vocabulary
    patch = pytest.MonkeyPatch()
    patch.setattr(brown, "cluster", lambda *a: caught.setdefault("classes", cluster(*a)))
    patch.setattr(brown, "read_vocabulary", lambda *a: caught.setdefault("known", read(*a)))
    patch.setattr(brown, "WORDS_AT_ONCE", 7)
    rows = made()
    frame = spark.createDataFrame([(*r, "s", "r", "t") for r in rows], SCHEMA).repartition(3)
    found = brown.score_texts(frame, "out", head=2000, shapes=8, how_many=5, passes=4, counted=9000).toPandas()
    patch.undo()
    return rows, found, caught["known"], caught["classes"]


def split(text):
    return (text or "").encode().lower().split()


def test_scores_equal_a_plain_version(scored):
    rows, found, known, classes = scored
    training = [split(t) for _, t, held in rows if not held]
    counts = Counter(w for words in training for w in words)
    total, distinct = sum(counts.values()) + len(training), len(counts) + 1
    first = len(known.head) + 1
    assert known.tokens == total and known.words == distinct and all(counts[w] == c for w, (_, c) in known.counted.items())
    assert len(known.head) < len(known.counted) < len(counts)

    def kind(word):
        return known.head[word][0] if word in known.head else first + brown.shape_of(word, 8)

    tokens_in, words_in, grams = Counter({0: len(training)}), Counter({0: 1}), Counter()
    for word, c in counts.items():
        tokens_in[classes[kind(word)]] += c
        words_in[classes[kind(word)]] += 1
    for words in training:
        own = [0, 0, *(classes[kind(w)] for w in words), 0]
        grams.update(zip(own, own[1:], own[2:], strict=False))
    lines = []
    single = {c: sum(n for g, n in grams.items() if g[2] == c) for c in range(5)}
    for _, text, held in rows:
        words = split(text)
        own = [0, 0, *(classes[kind(w)] for w in words), 0]
        base = score = 0.0
        for n, word in enumerate([*words, None]):
            c = counts[word] if word is not None else len(training)
            base += math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
            a, b, k = own[n], own[n + 1], own[n + 2]
            one = (single[k] + 0.1) / (sum(single.values()) + 0.1 * 5)
            two = (sum(grams[x, b, k] for x in range(5)) + 50 * one) / (sum(m for g, m in grams.items() if g[1] == b) + 50)
            three = (grams[a, b, k] + 50 * two) / (sum(m for g, m in grams.items() if g[:2] == (a, b)) + 50)
            score += math.log10(three * (c + 0.1) / (tokens_in[k] + 0.1 * (words_in[k] + 1)))
            if n > 300:
                break
        if len(words) < 300:
            lines.append((held, len(words) + 1, sum(w in counts for w in words) + 1, base, score))
    short = found[found["n_tokens"] <= 300]
    got = sorted(short[["held_out", "n_tokens", "n_known", "base_score", "score"]].itertuples(index=False, name=None))
    for mine, plain in zip(got, sorted(lines), strict=True):
        assert mine == pytest.approx(plain, rel=1e-9)
    assert len(found) == len(rows) and (found["train_tokens"] == total).all() and found["doc_id"].isna().sum() == 1
    assert (found[found["held_out"]]["score"].sum()) > found[found["held_out"]]["base_score"].sum()


def test_probabilities_add_up(scored):
    _, _, known, classes = scored
    rng = np.random.default_rng(1)
    model = brown.ClassModel.of(classes, rng.integers(0, 9, (5, 5, 5)), known)
    places = np.zeros(5)
    np.add.at(places, classes, known.counts + brown.DELTA * known.kinds)
    for before, last in itertools.product(range(5), repeat=2):
        assert (10.0 ** model.logs[before, last] * (places + brown.DELTA)).sum() == pytest.approx(1)


def test_exchange_takes_the_best_class():
    rng = np.random.default_rng(3)
    for _ in range(20):
        tokens = np.concatenate([[0], rng.integers(1, 7, 60), [0], rng.integers(1, 7, 40), [0]])
        classes = np.concatenate([[0], rng.integers(1, 4, 6)])

        def bigrams(given, tokens=tokens):
            found = np.zeros((4, 4), dtype=np.int64)
            np.add.at(found, (given[tokens[:-1]], given[tokens[1:]]), 1)
            return found

        after, before = np.zeros((7, 4), dtype=np.int64), np.zeros((7, 4), dtype=np.int64)
        np.add.at(after, (tokens[:-1], classes[tokens[1:]]), 1)
        np.add.at(before, (tokens[1:], classes[tokens[:-1]]), 1)
        itself = np.bincount(tokens[1:][tokens[1:] == tokens[:-1]], minlength=7)
        assert (brown.class_bigrams(after, classes, 4) == bigrams(classes)).all()
        for word in range(1, 7):
            new = brown.exchange(classes, after, before, itself, np.array([word]), 4)
            tried = []
            for c in range(1, 4):
                other = classes.copy()
                other[word] = c
                tried.append(brown.likelihood(bigrams(other)))
            assert brown.likelihood(bigrams(new)) == pytest.approx(max(tried))
            assert (np.delete(new, word) == np.delete(classes, word)).all()
        assert (brown.exchange(classes, after, before, itself, np.array([0]), 4) == classes).all()


def test_exchange_finds_word_kinds(scored):
    _, _, known, classes = scored
    kinds = {w.decode(): classes[n] for w, (n, _) in known.head.items()}
    assert not {kinds[w] for w in ("cat", "dog", "cow", "é")} & {kinds[w] for w in ("runs", "eats", "sits")}


def test_edges(spark):
    frame = spark.createDataFrame([(1, "a b", True), (2, None, None)], "doc_id long, text string, out boolean")
    assert brown.score_texts(frame.limit(0), "out").count() == 0
    rows = {r["doc_id"]: r for r in brown.score_texts(frame.where("doc_id = 1"), "out").collect()}
    assert (rows[1]["n_tokens"], rows[1]["n_known"], rows[1]["train_tokens"]) == (3, 0, 0) and math.isfinite(rows[1]["score"])
    both = {r["doc_id"]: r for r in brown.score_texts(frame, "out").collect()}
    assert (both[1]["n_known"], both[2]["n_tokens"], both[2]["held_out"]) == (1, 1, False)
    with pytest.raises(ValueError):
        brown.score_texts(frame, "out", head=1 << 16)


def test_held_out_texts_are_likelier(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = brown.score_texts(docs.withColumn("__out", crc_part("doc_id", 10) == 0), "__out", passes=3).where("held_out").toPandas()
    assert found["score"].sum() > found["base_score"].sum() and (found["score"] > found["base_score"]).mean() > 0.6
