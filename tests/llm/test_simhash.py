"""SimHash groups and near copies against brute force."""

import itertools
import random

import numpy as np
import pytest

from plumbscore.llm import simhash
from plumbscore.llm.components import components

WORDS = [f"word{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, extra string, fp string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def brute(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_bits():
    assert simhash.majority_fingerprint("") == simhash.majority_fingerprint(" \t\n") == 0
    import xxhash

    assert simhash.majority_fingerprint("One  two\tThree") == xxhash.xxh64_intdigest("one two three", 42)
    assert simhash.majority_fingerprint("only Two") == xxhash.xxh64_intdigest("only two", 42)
    # Only A-Z change case and only ASCII white space parts words.
    assert simhash.majority_fingerprint("É a") == xxhash.xxh64_intdigest("É a", 42)
    assert simhash.shingles_of([b"a", b"b", b"a", b"b", b"a"], 3) == [b"a b a", b"b a b", b"a b a"]


def test_pivots_tell_every_block():
    for blocks in (4, 5):
        masks = simhash.pivots(blocks)
        assert len(masks) == blocks
        covered = 0
        for own in masks:
            union = 0
            for m in own:
                union |= m
            assert not union & covered
            covered |= union
        assert covered == 2**64 - 1


@pytest.mark.parametrize("cell", [2, 16])
def test_links_find_all_components(spark, cell):
    rng = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            values.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 1, 2, 3, 5)))))
    values = [simhash._signed(v & (2**64 - 1)) for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "fp long").distinct()
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, cell=cell)).collect()}
    wanted = brute([(a, b) for a, b in itertools.combinations(values, 2) if bits(a, b) <= 2], values)
    assert {v: found.get(v, v) for v in values} == wanted


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7), (None, 1), (-3, 20)]
    found = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(5, 3), (4, 3), (9, 3), (3, 3), (20, -3), (21, -3), (-3, -3)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(60)]
    assert {r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_near_groups_edges(spark):
    rng = random.Random(1)
    same, other = prose(rng, 300), prose(rng, 20_000)
    rows = [(3, same), (1, same.upper()), (9, other), (4, None), (6, ""), (None, same), (9, other), (None, " ")]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], SCHEMA)
    found = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert len(found) == len(rows)
    zero = "0" * 16
    assert [(i, c) for i, f, c in found if f == zero] == [(-1, 4), (4, 4), (6, 4)]
    assert [(i, c) for i, f, c in found if f != zero] == [(-1, 1), (1, 1), (3, 1), (9, 9), (9, 9)]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_drop_near_copies(spark):
    rng = random.Random(2)
    texts, near = [], {}
    for i in range(60):
        texts.append(prose(rng, 200))
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:30]):
        words = t.split()
        words[rng.randrange(200)] = "changed"
        rows.append((200 + i, " ".join(words)))
        near[200 + i] = 100 + i
        rows.append((300 + i, t))
    rows += [(None, texts[0]), (100, texts[0]), (500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], SCHEMA)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids))
    # All originals and one empty text stay, exact copies go, and nearly all near ones.
    assert set(range(100, 160)) <= set(ids) and 500 in ids and 501 not in ids
    assert not [i for i in ids if i is None or 300 <= i < 400]
    assert sum(200 <= i < 300 for i in ids) <= 3
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_survivors_are_told_by_their_text(spark):
    rng = random.Random(3)
    one, two, three, four = (prose(rng, 200) for _ in range(4))
    rows = [(None, one), (None, two), (5, three), (5, four), (3, four), (7, three)]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], SCHEMA)
    kept = sorted(((r["doc_id"] or -1, r["text"]) for r in simhash.drop_near_copies(docs).collect()))
    assert kept == sorted([(-1, one), (-1, two), (5, three), (3, four)])


def jaccard(a, b):
    own, other = (set(simhash.shingles_of(simhash.words_of(t), 5)) for t in (a, b))
    return len(own & other) / len(own | other) if own | other else 1.0


def test_near_copies_share_their_shingles(spark):
    rng = random.Random(4)
    rows = []
    for family in range(6):
        words = prose(rng, 150).split()
        for _ in range(30):
            copy = list(words)
            for _ in range(rng.choice((0, 1, 2, 4, 8))):
                copy[rng.randrange(150)] = rng.choice(WORDS)
            if rng.random() < 0.4:
                # The same bag of words in another order, so the same fingerprints.
                start = rng.randrange(60)
                middle = copy[start : start + 60]
                rng.shuffle(middle)
                copy[start : start + 60] = middle
            rows.append((len(rows), " ".join(copy)))
        # One bag of words in two unlike orders: a large cell that is not one group.
        other = list(words)
        rng.shuffle(other)
        for _ in range(25):
            at = rng.randrange(149)
            changed = list(rng.choice((words, other)))
            changed[at], changed[at + 1] = changed[at + 1], changed[at]
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), ""), (len(rows) + 1, " ")]
    docs = spark.createDataFrame([(i, t, "x", "clash") for i, t in rows], SCHEMA)
    found = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect())
    prints = [simhash.weighted_fingerprints(t, 10) for _, t in rows]
    linked = [
        (a, b)
        for (a, x), (b, y) in itertools.combinations(rows, 2)
        if any(bits(p, q) <= 2 for p, q in zip(prints[a], prints[b], strict=True)) and jaccard(x, y) >= 0.8
    ]
    roots = brute(linked, [i for i, _ in rows])
    assert found == sorted(set(roots.values()))


def test_weighted_fingerprints_agree_with_sums():
    found = simhash.weighted_fingerprints("a b b c c c", 3)
    assert found == simhash.weighted_fingerprints("C b c A b c", 3)
    assert len(found) == 3 and len(set(found)) == 3
    assert simhash.weighted_fingerprints("", 2) == [0, 0]
    assert all(isinstance(x, int) and 0 <= x < 2**64 for x in found)
    assert np.bitwise_count(np.uint64(found[0])) > 0
