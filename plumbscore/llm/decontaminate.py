"""Benchmark decontamination: short test items found inside long documents.

The items are parted by size, that is by their number of different word shingles. Of an item of ``n`` shingles
the sketch holds those with the smallest hashes, as in MinHash. A document that holds a
share of at least ``share`` of the item lacks at most ``n - ceil(share * n)`` of its shingles, so a
sketch of one more must meet it: no part misses a containing document. Parts differ in the size
of that sketch, which follows from the largest item of the part. The shingles of the documents are
looked up among the sketches, once per text however often they repeat, and each text that meets one is verified by exact
containment: its different shingles, as text, are counted per item. Tables go to every task only if their written size allows it. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table, text_of
from plumbscore.operators.joins import broadcast_if_small
from plumbscore.session import materialize

SHINGLE = 5
SHARE = 0.8
ROW_BYTES = 128
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words_column(text: str) -> Column:
    """Words between ASCII white space, in lower case, without empty ones."""
    return F.filter(F.split(F.lower(text_of(text)), _SPACE), lambda w: w != "")


def shingle_texts(words: str, size: Column | int) -> Column:
    """All runs of ``size`` words, joined by a space; none if there are fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(F.col(words), i, size), " "))


def item_table(items: DataFrame, key: str = "item_id", text: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """One row per item that has words: ``key``, ``width``, ``shingles``, ``part`` and ``sketch``.

    ``width`` is the length of its shingles in words: ``shingle``, or all of an item that is
    shorter. ``part`` is the size class, by powers of two. ``sketch`` has the hashes of the
    shingles that must be looked for.
    """
    cut = items.select(key, words_column(text).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("width", F.least(F.lit(shingle), F.size("words")))
    cut = cut.select(key, "width", F.array_distinct(shingle_texts("words", F.col("width"))).alias("shingles"))
    cut = cut.withColumn("part", F.floor(F.log2(F.size("shingles").cast("double"))).cast("int"))
    parts = cut.groupBy("part").agg(F.max(F.size("shingles")).alias("largest"))
    # Enough for the largest item of the part, so for every one.
    parts = parts.withColumn("sketch_size", F.col("largest") - F.ceil(F.col("largest") * share - 1e-9) + 1)
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64(s)))
    return cut.join(parts, "part").select(key, "width", "part", "shingles", F.slice(hashes, F.lit(1), F.col("sketch_size").cast("int")).alias("sketch"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    item_key: str = "item_id",
    shingle: int = SHINGLE,
    share: float = SHARE,
) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``share`` of the shingles.

    Columns: ``keep``, the item's key, ``n_shingles`` of the item, ``n_found`` in the document
    and ``containment``. Rows that repeat give the same pair once. Items without words, and
    items with a null key, meet nothing; null and empty documents neither.
    """
    # Items that repeat a key with other texts are judged one by one, repeated rows once.
    made = item_table(items.where(F.col(item_key).isNotNull()), item_key, text, shingle, share)
    known = materialize(made.withColumn("__id", F.xxhash64("shingles")).dropDuplicates([item_key, "__id"]), "items")
    hashes = broadcast_if_small(known.select("width", F.explode("sketch").alias("__hash")).distinct(), ROW_BYTES)
    # An item that meets no hash of its sketch is held by nothing, so only the shingles of texts that meet one are compared.
    pieces = broadcast_if_small(known.select(F.col(item_key).alias("__item"), "__id", "width", F.explode("shingles").alias("__shingle")), ROW_BYTES)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    # Equal texts are told by a digest and judged once; the words of a text do not travel until it has met an item.
    named = docs.withColumn("__text", F.md5(text_of(text).cast("binary")))
    cut = named.select("__text", words_column(text).alias("__words")).where(F.size("__words") > 0)
    met = None
    for width in widths:
        runs = cut.where(F.size("__words") >= width).select("__text", "__words", F.posexplode("__words").alias("__at", "__word"))
        runs = runs.where(F.col("__at") <= F.size("__words") - width)
        run = F.concat_ws(" ", *[F.get("__words", F.col("__at") + i) for i in range(width)]) if width > 1 else F.col("__word")
        found = runs.select("__text", F.xxhash64(run).alias("__hash"), F.lit(width).alias("width")).join(hashes, ["width", "__hash"], "left_semi")
        met = found.select("__text") if met is None else met.union(found.select("__text"))
    if met is None:
        result = items.schema[item_key].dataType.simpleString()
        return docs.select(*keep).limit(0).selectExpr("*", f"CAST(NULL AS {result}) AS {item_key}", "0L AS n_shingles", "0L AS n_found", "0D AS containment")
    texts = broadcast_if_small(met.distinct(), ROW_BYTES)
    own = named.select("__text", text).join(texts, "__text", "left_semi").groupBy("__text").agg(F.first(text).alias(text))
    own = materialize(own.select("__text", words_column(text).alias("__words")), "met")
    shingles = None
    for width in widths:
        part = own.select("__text", F.lit(width).alias("width"), F.explode(F.array_distinct(shingle_texts("__words", width))).alias("__shingle"))
        shingles = part if shingles is None else shingles.union(part)
    counted = shingles.join(pieces, ["width", "__shingle"]).groupBy("__text", "__item", "__id").agg(F.count("*").alias("n_found"))
    sizes = known.select(F.col(item_key).alias("__item"), "__id", F.size("shingles").cast("long").alias("n_shingles"))
    sure = counted.join(sizes, ["__item", "__id"]).withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= share)
    sure = broadcast_if_small(sure.select("__text", F.col("__item").alias(item_key), "n_shingles", "n_found", "containment"), ROW_BYTES)
    return named.select(*keep, "__text").join(sure, "__text").drop("__text").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``docs`` that hold less than ``share`` of every benchmark item, all columns kept.

    Texts are told by a hash of the text, so rows whose key is null or repeated are judged
    by their own text.
    """
    own = docs.withColumn("__digest", F.xxhash64(F.md5(text_of(text).cast("binary")), F.length(text_of(text))))
    bad = materialize(contaminated(own, items, ["__digest"], text, share=share).select("__digest").distinct(), "contaminated")
    return own.join(bad, "__digest", "left_anti").select(*docs.columns)


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents
), pieces AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM words
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM benchmark
), item_pieces AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM item_words WHERE len(w) >= 5
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_pieces GROUP BY item_id
), found AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM pieces JOIN item_pieces USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles::DOUBLE AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found / n_shingles::DOUBLE >= 0.8
"""


@query("op8_benchmark_decontamination", ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with how much of it."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
