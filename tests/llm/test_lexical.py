"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from plumbscore.llm import lexical

SCHEMA = "doc_id long, text string, n string, ids string, score string"
PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    many, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    rows = []
    for key, wanted in asked.items():
        found = []
        for i, bag, n in bags:
            m = 50 + (50 * n * many) // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                found.append((-score, i is None, i or 0))
        rows += [(key, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(rows, key=str)


def made():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)] + ["Äpfel", "ÄPFEL", "x1y", "a-b"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(200)]
    docs += [(i + 500, "same words w1 w2 here") for i in range(40)] + [(3, "same words w1 w2 here"), (None, "same words w1 w2 here"), (None, "w5")]
    docs += [(700, None), (701, ""), (702, " -- "), (703, "w1 " * 60_000), (704, "\x00w1\x7fW2")]
    items = [(i, " ".join(rng.choice(words) for _ in range(8))) for i in range(25)]
    items += [(1, "w1 w2"), (None, "same words"), (30, None), (31, "!"), (32, "unheard"), (0, items[0][1])]
    return docs, items


@pytest.mark.parametrize("top, block_bytes, block_items", [(50, 1 << 21, 2000), (7, 400, 20)])
def test_equals_plain_ranking(spark, top, block_bytes, block_items, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS_AT_ONCE", 50)
    docs, items = made()
    frame = spark.createDataFrame([(i, t, "n", "i", "s") for i, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id int, text string, doc string")
    found = lexical.rank(frame, asked, top=top, block_bytes=block_bytes, block_items=block_items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["item_id"] == "int"
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, items, top)


def test_blocks_are_bounded(spark):
    pairs = lexical.item_terms(spark.createDataFrame([(str(i), f"one two{i}") for i in range(50)], "item_id string, text string"))
    blocks = lexical.item_blocks(pairs, 10**6, 8)
    assert len(blocks) > 6 and max(b.select("item").distinct().count() for b in blocks) <= 8
    assert sum(b.count() for b in blocks) == 100


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == lexical.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.rank(docs, items).collect()] == plain([(1, "a b")], [(1, "a")], 50)


def test_salted_first_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.lit(1).alias("k"), F.col("id"))
    assert [r["id"] for r in lexical.first_rows(rows, ["k"], [F.desc("id")], 3, F.xxhash64("id")).orderBy("id").collect()] == [2997, 2998, 2999]
