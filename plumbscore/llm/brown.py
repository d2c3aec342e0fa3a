"""Class-based n-grams: words in classes found by exchange, transitions between classes, emissions of words.

The probability of a token is that of its class after the two classes before it, times that of the word within its class:

``P(w | c'', c') = P(c | c'', c') * (count(w) + 0.1) / (count(c) + 0.1 * (words(c) + 1))``

Class transitions are trigrams that fall back to bigrams and single classes (Dirichlet smoothing with ``WEIGHT`` pseudo
counts). The one place beside the ``words(c)`` known words of a class is that of all its unknown words, as in the
base score, which is the same formula with a single class. The numerators of both scores are the same, so
one join of words with their counts serves both.

*Types.* Words with at least one in ``HEAD`` of all training tokens are types of their own; there are ``HEAD`` of them at
most, at every size. All other words, known or not, are dealt to ``SHAPES`` types by their spelling (the first and the last
bytes), so the number of types is a parameter and every word has a class. Counts of words cover the whole vocabulary: tasks
hold those of the words with more than one in ``COUNTED`` of all tokens, which are ``COUNTED`` at most, and texts meet all others by a join in which no word is a hot key.

*Exchange.* Texts are written once as sequences of types. Each pass counts, inside the tasks, how often each type
stands before and after each class; these tables have types times classes entries whatever the corpus
holds. Each type in turn then moves to the class with the largest likelihood of the class bigrams. A pass
moves a share of the types, so that the tables of a pass stay close to the truth, and passes end when nothing gains any more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import crc_part, query, table
from plumbscore.session import materialize

HEAD = 16384
COUNTED = 1 << 20
SHAPES = 1024
CLASSES = 64
PASSES = 8
SHARES = 2
DELTA = 0.1
WEIGHT = 50.0
WORDS_AT_ONCE = 200_000
END = 0  # the type that ends a text, alone in class 0, which is also what stands before a text


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def shape_of(word: bytes, shapes: int = SHAPES) -> int:
    """The type of a rare or unknown word, by its first and last bytes."""
    return xxhash.xxh64_intdigest(word[:2] + b" " + word[-3:], 1) % shapes


def _texts(docs: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    # The key's hash decides, a null key counts as the empty text.
    return docs.select(F.col(key).alias("doc"), F.col(held_out).alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over the training texts, one row a word; the ends of texts are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=pa.binary()), pa.array(counts.values(), type=pa.int64())], names=["word", "c"])

        for batch in batches:
            for body in batch.column(0):
                counts.update(words_of(body.as_py()))
                if len(counts) > WORDS_AT_ONCE:
                    yield rows()
                    counts.clear()
        yield rows()

    part = texts.where(~F.col("held")).select("t").mapInArrow(run, "word binary, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of words: frequent ones with type and count, those that are types first, and the sizes of all."""

    head: dict[bytes, tuple[int, int]]
    counted: dict[bytes, tuple[int, int]]
    rare: float  # words with no more tokens are not in ``counted``
    tokens: int
    texts: int
    words: int
    counts: np.ndarray  # training tokens by type
    kinds: np.ndarray  # different training words by type
    shapes: int

    @property
    def types(self) -> int:
        return len(self.counts)

    @property
    def denominator(self) -> float:
        return float(np.log10(self.tokens + DELTA * (self.words + 1)))


def read_vocabulary(counts: DataFrame, texts: int, head: int = HEAD, shapes: int = SHAPES, counted: int = COUNTED) -> Vocabulary:
    """The vocabulary of written word counts; ``texts`` is the number of training texts, each with one end."""
    found = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, words = found[0] + texts, found[1] + (texts > 0)
    least = tokens / head
    # Fewer than ``counted`` words can have a share of more than one in ``counted``, and fewer than ``head`` one in ``head``.
    rarest = tokens / max(counted, head)
    frequent = counts.where(F.col("c") > rarest).orderBy(F.desc("c"), "word").toArrow()
    listed = list(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True))
    known = {w: (n + 1, c) for n, (w, c) in enumerate(listed) if c > least}
    first = len(known) + 1
    all_counted = {w: (known[w][0] if w in known else first + shape_of(w, shapes), c) for w, c in listed}
    by_type, kinds = np.zeros(first + shapes, dtype=np.int64), np.zeros(first + shapes, dtype=np.int64)
    by_type[END], kinds[END] = texts, texts > 0
    for n, c in known.values():
        by_type[n], kinds[n] = c, 1

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of, words_in = np.zeros(shapes, dtype=np.int64), np.zeros(shapes, dtype=np.int64)
        for batch in batches:
            at = np.fromiter((shape_of(w, shapes) for w in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            np.add.at(tokens_of, at, batch.column(1).to_numpy())
            words_in += np.bincount(at, minlength=shapes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shapes)), pa.array(tokens_of), pa.array(words_in)], names=["shape", "c", "words"])

    rare = counts.where(F.col("c") <= least).mapInArrow(shaped, "shape long, c long, words long")
    for shape, c, n in rare.groupBy("shape").agg(F.sum("c"), F.sum("words")).collect():  # at most SHAPES rows
        by_type[first + shape], kinds[first + shape] = c, n
    return Vocabulary(known, all_counted, rarest, tokens, texts, words, by_type, kinds, shapes)


def type_sequences(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """``(row, doc, held, types, log_sum, n_known, rare, times)`` per text.

    ``types`` are the type numbers as packed 16-bit integers, the end last. ``log_sum`` adds ``log10(count + 0.1)`` over the tokens of
    counted words and the end; the rare and unknown words with their counts are listed beside it, to be joined.
    """
    shapes, end_count = known.shapes, known.texts
    first = len(known.head) + 1
    # At most COUNTED words; a broadcast is read once a process, not once a task.
    sent = texts.sparkSession.sparkContext.broadcast({w: (n, float(np.log10(c + DELTA))) for w, (n, c) in known.counted.items()})
    end_log = float(np.log10(end_count + DELTA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        number, logs = 0, sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                packed, sums, seen, rare, times, ends = [], [], [], [], [], [0]
                for body in part.column(2):
                    words = words_of(body.as_py())
                    at, total, n_known = {}, end_log, int(end_count > 0)
                    for word, n in Counter(words).items():
                        found = logs.get(word)
                        if found:
                            at[word] = found[0]
                            total += n * found[1]
                            n_known += n
                        else:
                            at[word] = first + shape_of(word, shapes)
                            rare.append(word)
                            times.append(n)
                    packed.append(np.fromiter(map(at.__getitem__, words), dtype="<u2", count=len(words)).tobytes() + b"\x00\x00")
                    sums.append(total)
                    seen.append(n_known)
                    ends.append(len(rare))
                rows = pa.array(np.arange(number, number + part.num_rows, dtype=np.int64) + base)
                number += part.num_rows
                offsets = pa.array(ends, type=pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, type=t)) for x, t in ((rare, pa.binary()), (times, pa.int64()))]
                values = [rows, part.column(0), part.column(1), pa.array(packed, type=pa.binary()), pa.array(sums, type=pa.float64()), pa.array(seen, type=pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(values, names=["row", "doc", "held", "types", "log_sum", "n_known", "rare", "times"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"row long, doc {kind}, held boolean, types binary, log_sum double, n_known long, rare array<binary>, times array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The types of a batch one text after the other, and the place after the last of each text."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flat = np.frombuffer(data, dtype="<u2", count=int(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0]))
    return flat.astype(np.int64), (offsets[1:] - offsets[0]) // 2


def _cells(wanted: DataFrame, count: str) -> np.ndarray:
    """The sums of the cells that tasks found."""
    summed = wanted.groupBy("cell").agg(F.sum(count).alias(count)).toArrow()
    return np.stack([summed.column("cell").to_numpy(), summed.column(count).to_numpy()])


def neighbour_counts(sequences: DataFrame, classes: np.ndarray, how_many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each type how often each class comes next and before, and how often the type follows itself.

    Before a text stands class 0, that of the end.
    """
    types = len(classes)
    size = types * how_many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * size + types, dtype=np.int64)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            if not len(flat):
                continue
            # The end of the text before is what stands before a text, and each text ends with one.
            previous = np.concatenate([[END], flat[:-1]])
            sums[:size] += np.bincount(previous * how_many + classes[flat], minlength=size)
            sums[size : 2 * size] += np.bincount(flat * how_many + classes[previous], minlength=size)
            sums[2 * size :] += np.bincount(flat[flat == previous], minlength=types)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    found = np.zeros(2 * size + types, dtype=np.int64)
    cells, n = _cells(sequences.select("types").mapInArrow(run, "cell long, n long"), "n")
    found[cells] = n
    return found[:size].reshape(types, how_many), found[size : 2 * size].reshape(types, how_many), found[2 * size :]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def class_bigrams(after: np.ndarray, classes: np.ndarray, how_many: int) -> np.ndarray:
    """Class bigram counts from the counts of classes after types."""
    found = np.zeros((how_many, how_many), dtype=np.int64)
    np.add.at(found, classes, after)
    return found


def likelihood(bigrams: np.ndarray) -> float:
    """What exchange maximises: the part of the log likelihood of class bigrams that depends on the classes."""
    return float(_xlogx(bigrams).sum() - _xlogx(bigrams.sum(axis=0)).sum() - _xlogx(bigrams.sum(axis=1)).sum())


def exchange(classes: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, moved: np.ndarray, how_many: int) -> np.ndarray:
    """Move the types ``moved`` one after the other to their best class, never the end, and none into the end's class.

    The class bigrams follow every move; the classes around a type are those of the start of the pass.
    """
    classes = classes.copy()
    table_of = class_bigrams(after, classes, how_many)
    sums = _xlogx(table_of)
    for word in moved:
        n = int(after[word].sum())
        if not n or word == END:
            continue
        own, s, p, d = classes[word], after[word].copy(), before[word].copy(), int(itself[word])
        # The type without itself among its neighbours; where it follows itself is added apart.
        s[own] -= d
        p[own] -= d
        if s.min() < 0 or p.min() < 0:
            continue
        table_of[own] -= s
        table_of[:, own] -= p
        table_of[own, own] -= d
        if table_of[own].min() < 0 or table_of[:, own].min() < 0:
            # Neighbours that moved since the pass began; the next pass counts anew.
            table_of[own] += s
            table_of[:, own] += p
            table_of[own, own] += d
            continue
        sums[own], sums[:, own] = _xlogx(table_of[own]), _xlogx(table_of[:, own])
        with_rows, with_columns = _xlogx(table_of + s[None, :]), _xlogx(table_of + p[:, None])
        diagonal = np.arange(how_many)
        gain = (with_rows - sums).sum(axis=1) + (with_columns - sums).sum(axis=0)
        gain -= (with_rows - sums)[diagonal, diagonal] + (with_columns - sums)[diagonal, diagonal]
        cross = table_of[diagonal, diagonal] + s + p + d
        gain += _xlogx(cross) - sums[diagonal, diagonal]
        rows, columns = table_of.sum(axis=1), table_of.sum(axis=0)
        gain -= _xlogx(rows + p + s.sum() + d) - _xlogx(rows + p) + _xlogx(columns + s + p.sum() + d) - _xlogx(columns + s)
        gain[classes[END]] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= gain[own] + 1e-9:
            best = int(own)
        classes[word] = best
        table_of[best] += s
        table_of[:, best] += p
        table_of[best, best] += d
        sums[best], sums[:, best] = _xlogx(table_of[best]), _xlogx(table_of[:, best])
    return classes


def first_classes(counts: np.ndarray, how_many: int) -> np.ndarray:
    """Types dealt to the classes by falling frequency, the end alone in class 0."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = order[order != END]
    classes = np.zeros(len(counts), dtype=np.int64)
    classes[order] = 1 + np.arange(len(order)) % (how_many - 1)
    return classes


def cluster(sequences: DataFrame, known: Vocabulary, how_many: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of every type, by ``passes`` passes over the training texts at most."""
    classes = first_classes(known.counts, how_many)
    order = np.lexsort((np.arange(known.types), -known.counts))
    still = 0
    for n in range(passes * SHARES):
        counted = neighbour_counts(sequences, classes, how_many)
        new = exchange(classes, *counted, order[n % SHARES :: SHARES], how_many)
        still = 0 if (new != classes).any() else still + 1
        classes = new
        if still == SHARES:
            break
    return classes


@dataclass
class ClassModel:
    """Classes of types and the log probabilities of classes, with the emission denominators taken off."""

    classes: np.ndarray
    logs: np.ndarray  # by the two classes before and the class

    @classmethod
    def of(cls, classes: np.ndarray, trigrams: np.ndarray, known: Vocabulary) -> ClassModel:
        """Smooth the class trigram counts (``before last``, ``last``, ``class``)."""
        how_many = trigrams.shape[0]
        bigrams = trigrams.sum(axis=0)
        singles = bigrams.sum(axis=0)
        one = (singles + DELTA) / (singles.sum() + DELTA * how_many)
        two = (bigrams + WEIGHT * one) / (bigrams.sum(axis=1, keepdims=True) + WEIGHT)
        three = (trigrams + WEIGHT * two) / (trigrams.sum(axis=2, keepdims=True) + WEIGHT)
        tokens, words = np.zeros(how_many), np.zeros(how_many)
        np.add.at(tokens, classes, known.counts)
        np.add.at(words, classes, known.kinds)
        return cls(classes, np.log10(three) - np.log10(tokens + DELTA * (words + 1)))

    def scores(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of the logs of each text."""
        if not len(ends):
            return np.zeros(0)
        last, before = _contexts(self.classes[flat], ends)
        each = np.concatenate([[0.0], np.cumsum(self.logs[before, last, self.classes[flat]])])
        starts = np.concatenate([[0], ends[:-1]])
        return each[ends] - each[starts]


def _contexts(classes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; a text begins after two ends."""
    last = np.concatenate([[0], classes[:-1]])
    before = np.concatenate([[0, 0], classes[:-2]]) if len(classes) > 1 else np.zeros(len(classes), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    last[starts] = 0
    before[starts] = 0
    second = starts + 1
    before[second[second < ends]] = 0
    return last, before


def class_trigrams(sequences: DataFrame, classes: np.ndarray, how_many: int) -> np.ndarray:
    """How often each class follows each two classes, in all ``sequences``."""
    size = how_many**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            if len(flat):
                own = classes[flat]
                last, before = _contexts(own, ends)
                sums += np.bincount((before * how_many + last) * how_many + own, minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "n"])

    found = np.zeros(size, dtype=np.int64)
    cells, n = _cells(sequences.select("types").mapInArrow(run, "cell long, n long"), "n")
    found[cells] = n
    return found.reshape(how_many, how_many, how_many)


def score_texts(docs: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", head: int = HEAD, shapes: int = SHAPES, how_many: int = CLASSES, passes: int = PASSES, counted: int = COUNTED) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` is a boolean column; its true rows are scored and not learnt from, and null counts as false. Scores are log10
    probabilities of the whole text with its end. A null or empty text is its end alone. Rows that repeat, and
    rows of a repeated or null key, are texts of their own. Without training texts all words are unknown. Other columns are not read.
    """
    if head + shapes >= 1 << 16 or how_many < 2:
        raise ValueError("types must fit 16 bits, and there are two classes at least")
    flagged = docs.withColumn("__held", F.coalesce(F.col(held_out), F.lit(False)))
    texts = _texts(flagged, key, text, "__held")
    training = texts.where(~F.col("held")).count()
    counts = materialize(word_counts(texts), "word-counts")
    known = read_vocabulary(counts, training, head, shapes, counted)
    sequences = materialize(type_sequences(texts, known), "type-sequences")
    learnt = sequences.where(~F.col("held"))
    classes = cluster(learnt, known, how_many, passes)
    model = ClassModel.of(classes, class_trigrams(learnt, classes, how_many), known)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _flat(batch.column(5))
            tokens = np.diff(ends, prepend=0)
            columns = [batch.column(n) for n in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens), pa.array(model.scores(flat, ends))], names=["row", "doc", "held", "log_sum", "n_known", "n_tokens", "class_sum"])

    kind = texts.schema["doc"].dataType.simpleString()
    own = sequences.select("row", "doc", "held", "log_sum", "n_known", "types").mapInArrow(
        scored, f"row long, doc {kind}, held boolean, log_sum double, n_known long, n_tokens long, class_sum double"
    )
    # Rare words have one in ``counted`` of the tokens at most, so none is a hot key.
    pairs = sequences.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", "w.rare", "w.times")
    rare = counts.where(F.col("c") <= known.rare)
    joined = pairs.join(rare.withColumnRenamed("word", "rare"), "rare", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(DELTA))).alias("rare_sum")
    sums = joined.groupBy("row").agg(logs, F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    numerator = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return own.join(sums, "row", "left").select(
        F.col("doc").alias(key),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (numerator - F.col("n_tokens") * F.lit(known.denominator)).alias("base_score"),
        (numerator + F.col("class_sum")).alias("score"),
    )


@query("op12_brown_language_model")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The log10 probability of every document, learnt from nine tenths of them."""
    docs = table(spark, folder, "documents")
    return score_texts(docs.withColumn("__out", crc_part("doc_id", 10) == 0), "__out")
