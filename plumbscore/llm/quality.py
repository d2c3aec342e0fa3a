"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in turn; each step fits a
shallow tree on one feature to the residuals and adds its leaves to that feature's table, so
a feature ends up as one lookup table. The pairs of features that explain most of what is
left are boosted in the same way on a grid of coarser bins. A score is a sum of table
entries, looked up for whole columns at once.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import crc_part, map_rows, query, table, text_of
from plumbscore.session import materialize

FEATURES = (
    "chars",
    "words",
    "word_length",
    "long_words",
    "upper",
    "digits",
    "symbols",
    "shouts",
    "bars",
    "symbol_ends",
    "commas",
    "stops",
    "lines",
    "line_words",
    "distinct_words",
    "top_word",
    "same_again",
    "longest_run",
    "repeated_lines",
    "repeated_triples",
    "compressed",
)
MAX_LABELLED = 20_000
KEEP_SCORE = 0.3

_SYMBOL = re.compile(r"[^\w\s.,;:'\"?!()|-]")
_ENDS_IN_SYMBOL = re.compile(r"[^\w\s.,;:'\"?()|-](?=\s|$)")


def features(text: str) -> list[float]:
    """The values of ``FEATURES`` for a whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    chars, n = len(text), len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lowered = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    upper = np.count_nonzero(points != lowered) if len(points) == len(lowered) else sum(map(str.isupper, text))
    runs = [len(list(group)) for _, group in itertools.groupby(words)]
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    raw = text.encode("utf-8", "surrogatepass")
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        letters / n,
        sum(len(w) > 14 for w in words) / n,
        upper / letters,
        np.count_nonzero((points >= 48) & (points <= 57)) / letters,
        len(_SYMBOL.findall(text)) / letters,
        (text.count("!") + text.count("?")) / n,
        text.count("|") / n,
        len(_ENDS_IN_SYMBOL.findall(text)) / n,
        (text.count(",") + text.count(";")) / n,
        text.count(".") / n,
        len(lines) / n,
        n / max(1, len(lines)),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        1 - len(runs) / n,
        max(runs) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def with_features(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``x``, the features of the whole text; null counts as empty."""

    def rows(batch: list[dict]) -> list[dict]:
        for row in batch:
            row["x"] = features(row.pop("__text"))
        return batch

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs.select(*keep, text_of(text).alias("__text")), rows, f"{schema}, x array<double>")


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, and tables of pairs over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``, by adding table entries."""
        total = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, values in self.pairs:
            i = np.searchsorted(self.coarse[a], x[:, a], side="right")
            total += values[i, np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.empty(0)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values of a greedy tree over ordered bins, spread back to the bins."""
    cuts = [0, len(grad)]
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    for _ in range(leaves - 1):
        best, at = 1e-9, None
        for lo, hi in itertools.pairwise(cuts):
            if hi - lo < 2:
                continue
            mid = np.arange(lo + 1, hi)
            gl, hl, gr, hr = g[mid] - g[lo], h[mid] - h[lo], g[hi] - g[mid], h[hi] - h[mid]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = float(gain[k]), int(mid[k])
        if at is None:
            break
        cuts = sorted([*cuts, at])
    values = np.zeros(len(grad))
    for lo, hi in itertools.pairwise(cuts):
        values[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + ridge)
    return values


def _grid_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Two cuts, one along each axis of a grid of bins: four leaf values and their gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return np.zeros_like(grad), 0.0
    quarters = []
    for c in (g, h):
        nw = c[:-1, :-1]
        ne, sw = c[:-1, -1:] - nw, c[-1:, :-1] - nw
        quarters.append((nw, ne, sw, c[-1, -1] - nw - ne - sw))
    gain = sum(a**2 / (b + ridge) for a, b in zip(*quarters, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = [float(a[i, j] / (b[i, j] + ridge)) for a, b in zip(*quarters, strict=True)]
    values = np.empty_like(grad)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf
    return values, float(gain[i, j])


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 32,
    coarse_bins: int = 8,
    rounds: int = 150,
    pair_rounds: int = 60,
    how_many_pairs: int = 6,
    leaves: int = 4,
    rate: float = 0.1,
    ridge: float = 5.0,
) -> AdditiveModel:
    """Cyclic boosting of shallow trees with log loss, then of the strongest pairs.

    Without rows, or with one label only, the tables stay zero and the intercept is the
    smoothed log odds of the labels.
    """
    y = np.asarray(y, dtype=float)
    x = np.asarray(x, dtype=float).reshape(len(y), -1 if len(y) else len(FEATURES))
    width = x.shape[1]
    edges = [_edges(x[:, j], bins) if len(y) else np.empty(0) for j in range(width)]
    coarse = [_edges(x[:, j], coarse_bins) if len(y) else np.empty(0) for j in range(width)]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(width):
            p = 1.0 / (1.0 + np.exp(-total))
            size = len(edges[j]) + 1
            step = rate * _tree(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), leaves, ridge)
            model.tables[j] += step
            total += step[at[j]]
    # The pairs whose first tree would gain most from what the features alone have left.
    near = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(near[a] * shape[1] + near[b], weights, shape[0] * shape[1]).reshape(shape)

    p = 1.0 / (1.0 + np.exp(-total))
    gains = [(_grid_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), ridge)[1], a, b) for a, b in itertools.combinations(range(width), 2)]
    chosen = [(a, b) for gain, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:how_many_pairs] if gain > 0]
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for a, b in chosen]
    for _ in range(pair_rounds):
        for a, b, values in model.pairs:
            p = 1.0 / (1.0 + np.exp(-total))
            step = rate * _grid_tree(grid(a, b, y - p), grid(a, b, p * (1 - p)), ridge)[0]
            values += step
            total += step[near[a], near[b]]
    return model


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int = MAX_LABELLED) -> DataFrame:
    """``key`` and ``label`` (0 or 1) of about ``limit`` rows at most, chosen by a hash of the key.

    Rows with a null key or another label teach nothing. A key labelled twice counts twice.
    """
    known = labels.select(F.col(key), F.col(label).cast("int").alias(label)).where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    rows = known.count()
    return known if rows <= limit else known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * limit / rows))


def fit_labelled(featured: DataFrame, sample: DataFrame, key: str, label: str, limit: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on the rows of ``sample``, of which at most ``limit`` reach the driver."""
    rows = featured.join(sample, key).orderBy(F.xxhash64(key), key).limit(limit).select("x", label).toPandas()
    return fit(np.array(rows["x"].tolist(), dtype=float), rows[label].to_numpy())


def score(featured: DataFrame, model: AdditiveModel) -> DataFrame:
    """``featured`` without ``x`` but with ``score``; one vectorised call per Arrow batch."""
    kept = [c for c in featured.columns if c != "x"]
    schema = ", ".join(f"`{c}` {featured.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            values = np.asarray(x.flatten(), dtype=float).reshape(len(x), -1)
            found = model.scores(values) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], [*kept, "score"])

    return featured.mapInArrow(run, f"{schema}, score double")


def drop_low_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = KEEP_SCORE) -> DataFrame:
    """``docs`` whose whole text scores at least ``least``, all columns kept.

    The model is fitted on the labelled rows among ``docs``; ``labels`` has ``key`` and ``quality``.
    """
    sample = materialize(labelled_sample(labels, key, "quality"), "labelled")
    # The sample is bounded, so its keys can go to every task.
    shown = docs.join(F.broadcast(sample.select(key).distinct()), key, "left_semi")
    model = fit_labelled(materialize(with_features(shown, [key], text), "features"), sample, key, "quality")
    return filtered(docs, text, features, lambda x: model.scores(x) >= least)


def filtered(docs: DataFrame, text: str, measure: Callable[[str], list[float]], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` chooses by what ``measure`` finds in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = np.array([measure(t or "") for t in part.column(text).to_pylist()], dtype=float)
                yield part.filter(pa.array(keep(x)))

    return docs.mapInArrow(run, docs.schema)


@query("op3_quality_additive_model")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality score; a fifth of the rows is held out of the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    featured = materialize(with_features(docs, ["doc_id"]), "features")
    taught = labels.where(crc_part("doc_id", 5) != 0)
    model = fit_labelled(featured, labelled_sample(taught, "doc_id", "quality"), "doc_id", "quality")
    return score(featured, model).select(
        "doc_id",
        (crc_part("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"),
    )
