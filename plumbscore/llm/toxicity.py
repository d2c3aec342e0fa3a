"""Toxicity by weak supervision.

Lexicon and pattern voters say toxic, clean or nothing about a text. Some lexicons are fixed
lists, others are markers (words and word beginnings) found by their share in texts labelled toxic and
clean. A generative label model estimates by expectation maximisation how often each voter
says what about either class, and from what the classes leave unexplained which voters
repeat each other. The posterior labels it gives to labelled and unlabelled texts alike train a
linear classifier, and that scores every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.quality import MAX_LABELLED, filtered, labelled_sample
from plumbscore.llm.registered import crc_part, map_rows, query, table, text_of
from plumbscore.session import materialize

REJECT_SCORE = 0.7
MAX_TEXTS = 20_000
MAX_CANDIDATES = 3_000
MAX_MARKERS = 64

# The lexicons of the voters.
LEXICONS = {
    "names": "idiot idiots moron morons imbecile imbeciles cretin dunce dimwit dumbass fool fools jerk loser losers clown clowns pig",
    "scorn": "stupid dumb pathetic worthless useless brainless spineless clueless ridiculous hopeless",
    "filth": "trash scum garbage filth filthy vermin disgusting vile repulsive gross nasty",
    "swearing": "damn crap bastard bastards bitch bitches asshole assholes shit shitty fuck fucking fucker bullshit",
    "hate": "hate hates despise loathe detest",
    "threats": "kill choke beat hurt",
}
# Words of these are hardly ever found in an ordinary text.
STRONG = ("names", "scorn", "filth", "swearing")
_WORD_TO_LEXICON = {w: name for name, words in LEXICONS.items() for w in words.split()}
_STRONG_WORDS = "|".join(sorted(w for w, name in _WORD_TO_LEXICON.items() if name in STRONG))
_WORDS = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(rf"\b(?:you|your|he|she|they|u)\b(?:\W+\w+){{0,2}}?\W+(?:{_STRONG_WORDS})\b")
_PHRASES = re.compile(r"\b(?:shut\s+up|get\s+lost|go\s+to\s+hell|drop\s+dead)\b")
_MASKED = re.compile(r"\b[a-z]+[013457@$*][a-z013457@$*]*[a-z]\b")
_UNMASK = str.maketrans("013457@$", "oleastas")
_UNMASK_I = str.maketrans("013457@$", "oieastas")

COUNTS = (*LEXICONS, "strong_kinds", "aimed", "phrases", "masked", "words")
BEGINNINGS = (4, 5, 6, 7)


def beginnings(word: str) -> Iterable[str]:
    """What of a word can be a marker: its beginnings, or all of a very short one."""
    if len(word) < BEGINNINGS[0]:
        return (word + " ",)
    return [word[:n] for n in BEGINNINGS if n <= len(word)]


def measure(text: str, markers: dict[str, int]) -> list[int]:
    """The values of ``COUNTS`` for a whole text, then how often each marker occurs."""
    low = text.lower()
    words = _WORDS.findall(low)
    counts = Counter(words)
    found: Counter = Counter()
    kinds = 0
    for word in _WORD_TO_LEXICON.keys() & counts.keys():
        found[_WORD_TO_LEXICON[word]] += counts[word]
        kinds += _WORD_TO_LEXICON[word] in STRONG
    masked = 0
    for word in _MASKED.findall(low):
        masked += any(_WORD_TO_LEXICON.get(w) in STRONG for w in (word.translate(_UNMASK), word.translate(_UNMASK_I)))
    aimed = len(_AIMED.findall(low)) if kinds else 0
    own = [0] * len(markers)
    if markers:
        for word, count in counts.items():
            for part in beginnings(word):
                at = markers.get(part)
                if at is not None:
                    own[at] += count
    return [*(found[name] for name in LEXICONS), kinds, aimed, len(_PHRASES.findall(low)), masked, len(words), *own]


def with_counts(docs: DataFrame, markers: Sequence[str], keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``counts``, as an array of ints; a null text counts as empty."""
    places = {m: i for i, m in enumerate(markers)}

    def rows(batch: list[dict]) -> list[dict]:
        for row in batch:
            row["counts"] = measure(row.pop("__text"), places)
        return batch

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs.select(*keep, text_of(text).alias("__text")), rows, f"{schema}, counts array<int>")


def find_markers(labelled: DataFrame, label: str, text: str = "text", least: int = 4, most: int = MAX_MARKERS) -> list[tuple[str, int]]:
    """Word beginnings that tell texts labelled 1, with how often each must occur to count.

    ``labelled`` is the bounded sample of labelled texts. Its beginnings are counted by Spark; at most
    ``MAX_CANDIDATES`` that are much commoner in toxic texts come to the driver. Of these the one that
    tells most toxic texts not told so far is taken, again and again, so many copies of one
    text give no markers of their own.
    """

    def parts(batch: list[dict]) -> list[dict]:
        seen: Counter = Counter()
        for row in batch:
            counts: Counter = Counter()
            for word, count in Counter(_WORDS.findall(row["__text"].lower())).items():
                for part in beginnings(word):
                    counts[part] += count
            for part, count in counts.items():
                for k in (1, 2, 3):
                    if count >= k:
                        seen[part, k, row[label]] += 1
        return [{"part": p, "k": k, "y": y, "n": n} for (p, k, y), n in seen.items()]

    texts = labelled.select(label, text_of(text).alias("__text"))
    totals = {r[0]: r[1] for r in texts.groupBy(label).count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    pieces = map_rows(texts, parts, "part string, k int, y int, n long").groupBy("part", "k")
    shares = pieces.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    lift = (F.col("t") / toxic) / ((F.col("c") + 0.5) / clean)
    tells = shares.where((F.col("t") >= max(least, toxic // 200)) & (lift >= 8)).withColumn("worth", F.col("t") * F.log(lift))
    top = tells.orderBy(F.desc("worth"), "part", "k").limit(MAX_CANDIDATES).collect()
    if not top:
        return []
    place = {r["part"]: i for i, r in enumerate(sorted(top, key=lambda r: r["part"]))}
    names = {i: p for p, i in place.items()}

    def hits(batch: list[dict]) -> list[dict]:
        found = []
        for row in batch:
            counts: Counter = Counter()
            for word, count in Counter(_WORDS.findall(row["__text"].lower())).items():
                for part in beginnings(word):
                    if part in place:
                        counts[place[part]] += count
            found.append({"y": row[label], "hits": [i * 4 + min(3, c) for i, c in sorted(counts.items())]})
        return found

    rows = map_rows(texts, hits, "y int, hits array<int>").where("size(hits) > 0 AND y = 1").select("hits").toPandas()["hits"]
    told: dict[tuple[int, int], set[int]] = {}
    for n, codes in enumerate(rows):
        for code in codes:
            for k in range(1, code % 4 + 1):
                told.setdefault((code // 4, k), set()).add(n)
    false = {(place[r["part"]], r["k"]): r["c"] for r in top}
    chosen: list[tuple[str, int]] = []
    covered: set[int] = set()
    while len(chosen) < most:
        best = max(false, key=lambda c: (len(told.get(c, set()) - covered) * math.log1p(len(told.get(c, ())) / (1 + false[c])), -c[0], -c[1]), default=None)
        if best is None or len(new := told.get(best, set()) - covered) < least:
            break
        chosen.append((names[best[0]], best[1]))
        covered |= new
        del false[best]
    return chosen


def votes(counts: np.ndarray, needed: Sequence[int]) -> np.ndarray:
    """What each voter says of each row: 1 toxic, -1 clean, 0 nothing."""
    c = {name: counts[:, i] for i, name in enumerate(COUNTS)}
    marks = counts[:, len(COUNTS) :]
    strong = sum(c[name] for name in STRONG)
    enough = marks >= np.asarray(needed, dtype=int)[None, :]
    hits = np.where(enough, marks, 0).sum(axis=1)
    rate = (strong + hits) / np.maximum(1, c["words"])
    said = [np.where(c[name] > 0, 1, 0) for name in STRONG]
    said += [np.where(enough[:, j], 1, 0) for j in range(marks.shape[1])]
    said += [
        np.where(c["hate"] + c["threats"] > 1, 1, 0),
        np.where(c["aimed"] > 0, 1, 0),
        np.where(c["phrases"] > 0, 1, 0),
        np.where(c["masked"] > 0, 1, 0),
        np.where(c["strong_kinds"] + enough.sum(axis=1) >= 2, 1, 0),
        np.where(strong + hits >= 3, 1, 0),
        np.where(rate >= 0.01, 1, 0),
        np.where(strong + c["masked"] + hits == 0, -1, 0),
        np.where(strong + c["hate"] + c["threats"] + c["phrases"] + marks.sum(axis=1) == 0, -1, 0),
    ]
    return np.stack(said, axis=1) if len(counts) else np.zeros((0, len(said)), dtype=int)


@dataclass
class LabelModel:
    """Class share, what each voter says about either class, and how much of it is its own."""

    share: float
    log_said: np.ndarray  # voter, class, answer
    weights: np.ndarray
    correlations: np.ndarray

    def posterior(self, said: np.ndarray) -> np.ndarray:
        """Probability of the toxic class, with repeating voters counted in part."""
        odds = np.full(len(said), math.log(self.share / (1 - self.share)))
        for j, weight in enumerate(self.weights):
            odds += weight * (self.log_said[j, 1] - self.log_said[j, 0])[said[:, j] + 1]
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(said: np.ndarray, share: float = 0.1, rounds: int = 30, smoothing: float = 1.0) -> LabelModel:
    """Expectation maximisation from a majority vote; correlations from the residuals.

    Voters that vary together within both classes are down-weighted by the sum of their
    correlations, as if a clique of copies were one voter. The class share stays as given.
    """
    rows, voters = said.shape
    share = min(max(share, 1e-3), 0.5)
    posterior = np.where(said.sum(axis=1) > 0, 0.9, 0.02) if rows else np.empty(0)
    model = LabelModel(share, np.full((voters, 2, 3), math.log(1 / 3)), np.ones(voters), np.eye(voters))
    answers = [(said == v).astype(float) for v in (-1, 0, 1)]
    for _ in range(rounds if rows else 0):
        classes = np.stack([1 - posterior, posterior], axis=1)
        share_of = np.stack([a.T @ classes for a in answers], axis=2) + smoothing
        model.log_said = np.log(share_of / share_of.sum(axis=2, keepdims=True))
        means = (np.exp(model.log_said[:, :, 2]) - np.exp(model.log_said[:, :, 0])).T
        left = said - classes @ means
        spread = np.sqrt((left**2).mean(axis=0)) + 1e-9
        model.correlations = (left.T @ left) / rows / np.outer(spread, spread)
        among = np.abs(model.correlations) - np.eye(voters) * np.abs(model.correlations)
        model.weights = 1.0 / (1.0 + np.where(among > 0.2, among, 0.0).sum(axis=1))
        found = model.posterior(said)
        if np.abs(found - posterior).max() < 1e-6:
            break
        posterior = found
    return model


def inputs(counts: np.ndarray, needed: Sequence[int]) -> np.ndarray:
    """What the linear classifier sees."""
    c = {name: counts[:, i].astype(float) for i, name in enumerate(COUNTS)}
    marks = counts[:, len(COUNTS) :].astype(float)
    enough = marks >= np.asarray(needed, dtype=float)[None, :]
    strong = sum(c[name] for name in STRONG) + c["masked"] + np.where(enough, marks, 0).sum(axis=1)
    columns = [np.log1p(c[name]) for name in (*LEXICONS, "aimed", "phrases", "masked")]
    columns += [np.minimum(strong, 1.0), np.minimum(c["strong_kinds"] + enough.sum(axis=1), 4.0)]
    columns += [np.minimum(100 * strong / np.maximum(1.0, c["words"]), 5.0), np.log1p(strong)]
    return np.concatenate([np.stack(columns, axis=1), np.log1p(marks), enough.astype(float)], axis=1)


@dataclass
class Linear:
    """A linear classifier."""

    weights: np.ndarray
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each row of inputs."""
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.intercept, -30, 30)))


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> Linear:
    """Logistic regression on soft labels by Newton steps; all weights stay at least zero.

    Every input counts signs of toxicity, so a negative weight could only be noise.
    """
    size = x.shape[1]
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(size + 1)
    mean = min(max(float(target.mean()) if len(target) else 0.05, 1e-3), 1 - 1e-3)
    w[-1] = math.log(mean / (1 - mean))
    penalty = np.full(size + 1, ridge)
    penalty[-1] = 1e-6
    free = np.ones(size + 1, dtype=bool)
    for _ in range(rounds if len(x) else 0):
        p = 1.0 / (1.0 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - target) + penalty * w
        free[:-1] = (w[:-1] > 0) | (grad[:-1] < 0)
        hess = (full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty + 1e-6)
        step = np.zeros(size + 1)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        # Half steps keep the projection from swinging.
        before, w = w, w - np.clip(0.7 * step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(w - before).max() < 1e-7:
            break
    return Linear(w[:-1], float(w[-1]))


@dataclass
class ToxicityModel:
    """Markers with how often each must occur, and the classifier on their counts."""

    markers: list[str]
    needed: list[int]
    linear: Linear

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """One score per row of counts."""
        return self.linear.scores(inputs(counts, self.needed))


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", limit: int = MAX_TEXTS) -> ToxicityModel:
    """Fit on ``docs``: markers on labelled texts, label model and classifier on any texts.

    Both samples are bounded: at most about ``MAX_LABELLED`` labelled texts and ``limit`` of
    all, chosen by a hash of the key. Only the counts of the second reach the driver.
    """
    sample = materialize(labelled_sample(labels, key, label), "labelled")
    # The sample is bounded, so it can go to every task.
    shown = materialize(docs.select(key, text).join(F.broadcast(sample), key).select(label, text), "labelled_texts")
    found = find_markers(shown, label, text)
    markers, needed = [m for m, _ in found], [k for _, k in found]
    known = sample.agg(F.avg(label), F.count("*")).first()
    share = (known[0] * known[1] + 1) / (known[1] + 10) if known[1] else 0.1

    rows = docs.count()
    part = docs if rows <= limit else docs.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * limit / rows))
    counted = materialize(with_counts(part, markers, [key], text), "counts")
    lists = counted.orderBy(F.xxhash64(key), key).limit(limit).select("counts").toPandas()["counts"].tolist()
    counts = np.array(lists, dtype=int).reshape(len(lists), len(COUNTS) + len(markers))
    said = votes(counts, needed)
    posterior = fit_label_model(said, share).posterior(said)
    return ToxicityModel(markers, needed, fit_linear(inputs(counts, needed), posterior))


def with_scores(docs: DataFrame, model: ToxicityModel, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``score`` of the whole text."""
    places = {m: i for i, m in enumerate(model.markers)}

    def rows(batch: list[dict]) -> list[dict]:
        scores = model.scores(np.array([measure(row.pop("__text"), places) for row in batch], dtype=int))
        for row, score in zip(batch, scores.tolist(), strict=True):
            row["score"] = score
        return batch

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs.select(*keep, text_of(text).alias("__text")), rows, f"{schema}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: float = REJECT_SCORE) -> DataFrame:
    """``docs`` whose whole text scores less than ``most``, all columns kept.

    The model is fitted on ``docs`` and on the labels that fit them.
    """
    model = fit_toxicity(docs, labels, key, "toxic", text)
    places = {m: i for i, m in enumerate(model.markers)}
    return filtered(docs, text, lambda body: measure(body, places), lambda counts: model.scores(counts.astype(int)) < most)


@query("op7_toxicity_weak_supervision")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its toxicity score; a third of the rows is held out of the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    taught = crc_part("doc_id", 3) != 1
    model = fit_toxicity(docs.where(taught), labels.where(taught))
    return with_scores(docs, model, ["doc_id"]).select(
        "doc_id",
        (crc_part("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_SCORE).cast("int").alias("predicted"),
    )
