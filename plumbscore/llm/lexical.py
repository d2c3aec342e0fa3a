"""Ranked lexical search by bags: documents that look alike to the items are scored once.

A document matters to the ranking only through the terms it shares with the items (its bag: term
numbers and counts) and its length norm ``m``. Documents with equal bags and equal ``m`` are one
class: they meet by a hash and the bags themselves are compared, as the hash stands beside them in the
grouping key. Each class is scored once for all items, inside the tasks, and the classes that reach
a ranking are opened again: their members follow each other by ascending key.

Items come in blocks, so what a task holds of them is bounded by ``BLOCK_BYTES`` and
``BLOCK_ITEMS`` (a single larger item is a block of its own). Every block is searched in all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table
from plumbscore.session import materialize

TOP = 50
BLOCK_BYTES = 1 << 21
BLOCK_ITEMS = 2000
PAIRS_AT_ONCE = 1 << 21
SALTS = 64
# Letters and digits of ASCII, in lower case, and all bytes of other characters; the rest parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_TERMS).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, term)``, each pair once; items of a repeated key are taken together, null is a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, terms = [], []
            for name, body in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = list(dict.fromkeys(terms_of(body or b"")))
                names += [name] * len(found)
                terms += found
            column = pa.array([n.as_py() for n in names], type=batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([column, pa.array(terms, type=pa.binary())], names=["item", "term"])

    kind = items.schema[key].dataType.simpleString()
    return items.select(F.col(key).alias("item"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, f"item {kind}, term binary").distinct()


def item_blocks(terms: DataFrame, most_bytes: int = BLOCK_BYTES, most_items: int = BLOCK_ITEMS) -> list[DataFrame]:
    """``terms`` cut by a hash of the item into blocks that hold no more than the bounds, or a single item."""
    sizes = materialize(terms.groupBy("item").agg(F.sum(F.length("term") + 1).alias("bytes")), "item-sizes")
    how_many = 1
    while True:
        block = F.pmod(F.xxhash64("item"), F.lit(how_many))
        filled = sizes.groupBy(block.alias("block")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
        if filled.where((F.col("items") > 1) & ((F.col("bytes") > most_bytes) | (F.col("items") > most_items))).isEmpty():
            used = sorted(r[0] for r in filled.select("block").collect())
            return [terms.where(block == n) for n in used] if how_many > 1 else [terms]
        how_many *= 2


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, n, ids, tfs)`` of every document with a term: its length and the counts of known terms, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, ids, tfs, ends = [], [], [], [], [0]
            for at, body in enumerate(batch.column(1)):
                found = terms_of(body.as_py() or b"")
                if not found:
                    continue
                kept.append(at)
                lengths.append(len(found))
                own = sorted((vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary)
                ids += [t for t, _ in own]
                tfs += [c for _, c in own]
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(x, type=pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, type=pa.int32())), pa.array(lengths, type=pa.int64()), *lists], names=["doc", "n", "ids", "tfs"])

    chosen = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").cast("binary").alias("t"))
    return chosen.mapInArrow(run, "doc long, n long, ids array<int>, tfs array<int>")


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[Column], how_many: int, salt: Column) -> DataFrame:
    """Of each group the first ``how_many`` rows. Groups are cut by ``salt`` first, so no task gets what all tasks found of one."""
    cut = rows.withColumn("__salt", F.pmod(salt, F.lit(SALTS)))
    for keys in ([*by, "__salt"], list(by)):
        numbered = cut.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        cut = numbered.where(F.col("__place") <= how_many).drop("__place")
    return cut.drop("__salt")


class Scorer:
    """Scores of classes for the items of a block, and the best classes met so far."""

    def __init__(self, weights: np.ndarray, starts: np.ndarray, holders: np.ndarray, items: int, top: int) -> None:
        self.weights, self.starts, self.holders, self.items, self.top = weights, starts, holders, items, top
        # item, score, whether the key is null, least key, digest, m
        self.best = [np.zeros(0, dtype=np.int64) for _ in range(6)]
        self.least_score = np.ones(items, dtype=np.int64)

    def scores(self, rows: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray, how_many: int) -> np.ndarray:
        """Classes by items, in whole numbers; ``rows`` and ``m`` stand beside ``ids`` and ``tfs``."""
        worth = self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))
        held = self.starts[ids + 1] - self.starts[ids]
        before = np.cumsum(held) - held
        at = np.arange(int(held.sum())) - np.repeat(before - self.starts[ids], held)
        found = np.zeros(how_many * self.items, dtype=np.int64)
        np.add.at(found, np.repeat(rows * self.items, held) + self.holders[at], np.repeat(worth, held))
        return found.reshape(how_many, self.items)

    def meet(self, offsets: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray, nulls: np.ndarray, least: np.ndarray, digest: np.ndarray) -> None:
        """Take a batch of classes in."""
        sizes = np.diff(offsets)
        held = np.concatenate([[0], np.cumsum(self.starts[ids + 1] - self.starts[ids])])[offsets]
        begin = 0
        while begin < len(m):
            # As many classes as keep the products of a step bounded, one at least.
            end = max(begin + 1, min(int(np.searchsorted(held, held[begin] + PAIRS_AT_ONCE, "right")) - 1, begin + max(1, PAIRS_AT_ONCE // self.items)))
            part = slice(offsets[begin], offsets[end])
            rows = np.repeat(np.arange(end - begin), sizes[begin:end])
            found = self.scores(rows, ids[part], tfs[part], np.repeat(m[begin:end], sizes[begin:end]), end - begin)
            row, item = np.nonzero(found >= self.least_score)
            self._keep(item, found[row, item], *(x[begin:end][row] for x in (nulls, least, digest, m)))
            begin = end

    def _keep(self, *more: np.ndarray) -> None:
        if not len(more[0]):
            return
        item, score, nulls, least, digest, m = (np.concatenate(x) for x in zip(self.best, more, strict=True))
        order = np.lexsort((digest, least, nulls, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        order = order[place < self.top]
        self.best = [x[order] for x in (np.concatenate([self.best[0], more[0]]), score, nulls, least, digest, m)]
        full = np.flatnonzero(place == self.top - 1)
        self.least_score[item[full]] = self.best_scores(item[full])

    def best_scores(self, items: np.ndarray) -> np.ndarray:
        """The lowest kept score of items whose ranking is full."""
        return self.best[1][np.searchsorted(self.best[0], items, "right") - 1]


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _rank_block(spark: SparkSession, docs: DataFrame, terms: DataFrame, key: str, text: str, top: int) -> DataFrame:
    """``(item, rank, doc, score)`` for the items of one block."""
    pairs = terms.toArrow()  # at most a block, see item_blocks
    kind = terms.schema["item"].dataType.simpleString()
    names = pairs.column("item").combine_chunks()
    coded = names.dictionary_encode(null_encoding="encode")
    vocabulary = {t: n for n, t in enumerate(sorted(set(pairs.column("term").to_pylist())))}
    ids = np.array([vocabulary[t] for t in pairs.column("term").to_pylist()], dtype=np.int64)
    numbers = _numpy(coded.indices).astype(np.int64)
    by_term = np.argsort(ids, kind="stable")
    holders, starts = numbers[by_term], np.searchsorted(ids[by_term], np.arange(len(vocabulary) + 1))

    found = materialize(bags(docs, vocabulary, key, text), "bags")
    total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    result = f"item {kind}, rank int, doc long, score long"
    if not total[0]:
        return spark.createDataFrame([], result)
    df = np.zeros(len(vocabulary), dtype=np.int64)
    held = found.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow()  # at most the vocabulary of a block
    df[_numpy(held.column("id").combine_chunks())] = _numpy(held.column("count").combine_chunks())
    weights = np.floor(1000 * np.log((2 * total[0] + 2) / (2 * df + 1))).astype(np.int64)

    norm = F.expr(f"50L + ((50L * n * {total[0]}L) div {total[1]}L)")
    known = found.where(F.size("ids") > 0).withColumn("m", norm).withColumn("digest", F.xxhash64("m", "ids", "tfs"))
    own = ["digest", "m", "ids", "tfs"]
    classes = known.groupBy(*own).agg(F.min("doc").alias("least"))
    how_many = len(coded.dictionary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights, starts, holders, how_many, top)
        for batch in batches:
            lists = batch.column(2)
            nulls = _numpy(batch.column(4).is_null()).astype(np.int64)
            least = _numpy(batch.column(4).fill_null(0))
            offsets = _numpy(lists.offsets).astype(np.int64)
            flat = [_numpy(batch.column(n).flatten()).astype(np.int64) for n in (2, 3)]
            scorer.meet(offsets - offsets[0], *flat, _numpy(batch.column(1)), nulls, least, _numpy(batch.column(0)))
        item, value, nulls, least, digest, m = scorer.best
        least = pa.array(least, mask=nulls.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(value), least, pa.array(digest), pa.array(m)], names=["number", "score", "least", "digest", "m"])

    scored = classes.mapInArrow(score, "number long, score long, least long, digest long, m long")
    order = [F.desc("score"), F.asc_nulls_last("least"), F.asc("digest")]
    best = materialize(first_rows(scored, ["number"], order, top, F.col("digest")), "best")
    # At most ``top`` numbers an item of the block.
    reached = known.join(F.broadcast(best.select("digest").distinct()), "digest", "left_semi").select(*own, "doc")
    members = first_rows(reached, own, [F.asc_nulls_last("doc")], top, F.xxhash64("doc"))
    members = members.withColumn("least", F.min("doc").over(Window.partitionBy(*own)))
    same = (F.col("a.digest") == F.col("b.digest")) & (F.col("a.m") == F.col("b.m")) & F.col("a.least").eqNullSafe(F.col("b.least"))
    opened = best.alias("a").join(members.alias("b"), same).select("number", "score", "doc")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = opened.withColumn("rank", place).where(F.col("rank") <= top)
    labels = spark.createDataFrame(pa.table({"number": pa.array(np.arange(how_many)), "item": coded.dictionary}))
    return ranked.join(F.broadcast(labels), "number").select(F.col("item").cast(kind).alias("item"), "rank", "doc", "score")


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(item_key, rank, key, score)``: of each item the ``top`` best documents with a score above 0.

    Equal scores are ordered by ascending key, null keys last. Every row counts as a document of its
    own, so repeated keys and repeated rows each take a place. Null and empty texts have no terms; items
    without terms and items that meet nothing have no rows. Items that repeat a key are one item with the terms of all.
    ``key`` is a whole number; other columns are not read.
    """
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item_key, item_text), "item-terms")
    ranked = None
    for block in item_blocks(terms, block_bytes, block_items):
        found = _rank_block(spark, docs, block, key, text, top)
        ranked = found if ranked is None else ranked.union(found)
    return ranked.select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")


ORACLE = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), docs AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n FROM cut WHERE len(w) > 0
), total AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scores AS (
  SELECT item_id, r, sum(weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (r), total GROUP BY item_id, r
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


@query("op11_ranked_lexical_search", ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
