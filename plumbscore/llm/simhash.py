"""SimHash near-duplicates: groups of documents whose fingerprints differ in a few bits.

Fingerprints are made inside the tasks. Pairs come from a table of Hamming distances to
reference fingerprints (pivots), never from comparing all with all.

The pivots. Bits are dealt to ``blocks`` blocks. One pivot is the zero fingerprint; every
other one sets some bits of one block, in the pattern of a Walsh function. By the triangle
inequality two fingerprints ``radius`` apart differ by at most ``radius`` in every column of
the distance table. The columns of a block, less that of zero, depend on the bits of that block only, and ``radius`` differing bits touch at most ``radius`` blocks. So linked fingerprints
agree in all columns of at least ``blocks - radius`` blocks: they share a cell of the table,
which is an equality join. Pairs of a cell are discarded by their largest difference of a
column and the rest is verified by the Hamming distance itself.

A cell of more than ``CELL`` different fingerprints, as of large groups of near copies, would
give too many pairs. Its members are linked through midpoints instead: two fingerprints
differ in at most ``2 k`` bits if and only if some value is within ``k`` bits of both. All
values within ``k`` bits are written out and those who share one are linked to the smallest
of them. That is exact too, and its rows grow in proportion to the members.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.components import components
from plumbscore.llm.registered import map_rows, query, table, text_of
from plumbscore.llm.skew import join_counted
from plumbscore.session import materialize

BITS = 64
SEED = 42
CELL = 16
BLOCKS = 4
SHINGLE = 5
SHARE = 0.8
GOLDEN = 0x9E3779B97F4A7C15
MARKS = 16


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case and all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: Sequence[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by a space, repeats included; fewer words are one run."""
    if not words:
        return []
    if size == 1:
        return list(words)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) <= size:
        return [joined]
    return [joined[i:j] for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """Bit by bit: 1 if it is set in over half the XXH64 of the shingles; 0 without words."""
    runs = shingles_of(words_of(text), shingle)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(runs), 65536):
        part = runs[start : start + 65536]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(runs)).astype(np.uint8), bitorder="little").view("<u8")[0]) if runs else 0


def weighted_fingerprints(text: str, how_many: int, shingle: int = 1) -> list[int]:
    """``how_many`` independent fingerprints in which a term votes by the root of its count.

    The root keeps a word that fills a text, such as a separator, from deciding all bits.
    """
    counts = Counter(shingles_of(words_of(text), shingle))
    if not counts:
        return [0] * how_many
    seeds = (np.arange(1, how_many + 1, dtype=np.uint64) * np.uint64(GOLDEN))[None, :]
    votes = np.zeros(how_many * BITS)
    terms = list(counts.items())
    for start in range(0, len(terms), 4096):
        part = terms[start : start + 4096]
        base = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x, _ in part), dtype=np.uint64, count=len(part))
        mixed = base[:, None] ^ seeds
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ (mixed >> np.uint64(31))).astype("<u8")
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        weight = np.sqrt(np.fromiter((c for _, c in part), dtype=np.float64, count=len(part)))
        votes += 2.0 * (weight @ bits) - weight.sum()
    return np.packbits((votes > 1e-9).astype(np.uint8), bitorder="little").view("<u8").tolist()


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def with_fingerprints(docs: DataFrame, keep: Sequence[str], text: str = "text", shingle: int = 3, how_many: int = 0) -> DataFrame:
    """``keep`` plus ``fps``, an array of longs: one per fingerprint of the whole text.

    ``how_many`` 0 gives the one majority fingerprint, else as many weighted ones. A null
    text counts as empty; a text without words has fingerprint 0.
    """

    def rows(batch: list[dict]) -> list[dict]:
        for row in batch:
            body = row.pop("__text")
            found = weighted_fingerprints(body, how_many, shingle) if how_many else [majority_fingerprint(body, shingle)]
            row["fps"] = [_signed(x) for x in found]
        return batch

    kept = docs.select(*keep, text_of(text).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(kept, rows, f"{schema}, fps array<bigint>")


def pivots(blocks: int = BLOCKS) -> list[list[int]]:
    """The reference fingerprints of each block, as masks: Walsh patterns of its bits."""
    bounds = np.linspace(0, BITS, blocks + 1).round().astype(int)
    found = []
    for lo, hi in itertools.pairwise(bounds.tolist()):
        size = hi - lo
        order = 1 << (size - 1).bit_length()
        masks = []
        for row in range(order):
            mask = sum(1 << (lo + j) for j in range(size) if not bin(row & j).count("1") & 1)
            if mask and mask not in masks:
                masks.append(mask)
        found.append(masks)
    return found


def distance_table(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``fps`` (column ``fp``) plus ``zero_distance`` and ``pivot_distances``, an array per block."""

    def columns(masks: list[int]) -> Column:
        references = F.array(*[F.lit(_signed(m)) for m in masks])
        return F.transform(references, lambda m: F.bit_count(F.col("fp").bitwiseXOR(m)).cast("tinyint"))

    return fps.withColumns(
        {
            "zero_distance": F.bit_count("fp").cast("tinyint"),
            "pivot_distances": F.array(*[columns(masks) for masks in pivots(blocks)]),
        }
    )


def links(fps: DataFrame, radius: int = 2, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """``(a, b)``: edges whose components are those of all fingerprints ``radius`` apart or less.

    ``fps`` has distinct longs ``fp``. If there are columns ``series`` and ``node``, only
    fingerprints of one series are compared, and edges are between nodes instead.
    """
    names = [c for c in ("series", "node") if c in fps.columns]
    if radius % 2 or not 0 < radius < blocks:
        raise ValueError("radius must be even, positive and less than the number of blocks")
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    relative = [F.transform(F.col("pivot_distances")[b], lambda d: d - F.col("zero_distance")) for b in range(blocks)]
    marked = distance_table(fps, blocks).withColumns({f"block_{b}": F.xxhash64(relative[b]) for b in range(blocks)})
    series = [F.col("series")] if "series" in names else []
    keys = [F.xxhash64(F.lit(n), *series, *[F.col(f"block_{b}") for b in c]) for n, c in enumerate(chosen)]
    placed = marked.select(*names, "fp", F.explode(F.array(*keys)).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(placed.join(sizes, "cell"), "cells")

    small = distance_table(shared.where(F.col("members") <= cell), blocks)
    columns = [*names, "fp"]
    distances = F.concat(F.array("zero_distance"), F.flatten("pivot_distances"))
    left = small.select("cell", *[F.col(c).alias(f"{c}_a") for c in columns], distances.alias("d_a"))
    right = small.select("cell", *[F.col(c).alias(f"{c}_b") for c in columns], distances.alias("d_b"))
    pairs = left.join(right, "cell").where(F.col("fp_a") < F.col("fp_b"))
    far = F.exists(F.zip_with("d_a", "d_b", lambda x, y: F.abs(x - y)), lambda d: d > radius)
    near = pairs.where(~far & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius))
    end = "node" if "node" in names else "fp"
    found = near.select(F.col(f"{end}_a").alias("a"), F.col(f"{end}_b").alias("b"))

    crowded = shared.where(F.col("members") > cell).select(*names, "fp").distinct()
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in itertools.combinations(range(BITS), k)]
    around = F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))
    spread = crowded.select(*[c for c in names if c == "series"], F.col(end).alias("a"), F.explode(around).alias("middle"))
    by = [c for c in names if c == "series"] + ["middle"]
    least = spread.groupBy(*by).agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = spread.join(least, by).where(F.col("a") != F.col("b")).select("a", "b")
    return found.union(starred)


def fingerprint_groups(fps: DataFrame, radius: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, root)`` for those distinct fingerprints that are linked to another one."""
    found = components(links(fps, radius, blocks))
    return found.select(F.col("node").alias("fp"), "root")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest key that is reachable over fingerprints ``radius`` bits apart or
    less, the own key included. Texts without words have fingerprint zero and are linked like any other.
    Rows that repeat a key count each; null keys count only where a component has no other (then it is null).
    """
    made = with_fingerprints(docs, [key], text, shingle).select(key, F.col("fps")[0].alias("fp"))
    made = materialize(made, "fingerprints")
    classes = materialize(made.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "classes")
    groups = fingerprint_groups(classes.select("fp"), radius)
    rooted = materialize(classes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # A component may have very many fingerprints, and a fingerprint very many documents.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "least")
    named = materialize(join_counted(rooted.select("fp", "root", "n"), least, ["root"], "fps").select("fp", "component_id", "n"), "named")
    return join_counted(made, named, ["fp"], "n").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_shingles(docs: DataFrame, keep: Sequence[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` plus ``shingles``, the ascending different XXH64 of the text's shingles; empty without words.

    ``marks`` are ``MARKS`` longs of bits; every shingle flips one of them. So two sets differ in at least as many shingles as
    their marks differ in bits, see :func:`may_be_similar`.
    """

    def rows(batch: list[dict]) -> list[dict]:
        for row in batch:
            runs = set(shingles_of(words_of(row.pop("__text")), shingle))
            hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), dtype=np.uint64, count=len(runs))
            hashes = np.unique(hashes)
            row["shingles"] = np.sort(hashes.view(np.int64)).tolist()
            flips = np.bincount((hashes % np.uint64(MARKS * BITS)).astype(np.int64), minlength=MARKS * BITS) & 1
            row["marks"] = np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8").tolist()
        return batch

    kept = docs.select(*keep, text_of(text).alias("__text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(kept, rows, f"{schema}, shingles array<bigint>, marks array<bigint>")


def may_be_similar(share: float) -> Column:
    """False only if the sets of ``n_a`` and ``n_b`` shingles with ``marks_a`` and ``marks_b`` cannot have ``share`` in common.

    A Jaccard similarity of ``share`` leaves ``(n_a + n_b) * (1 - share) / (1 + share)`` shingles that only one of them has.
    """
    differing = sum((F.bit_count(F.col("marks_a")[i].bitwiseXOR(F.col("marks_b")[i])) for i in range(MARKS)), F.lit(0))
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share - 1e-9
    return sizes & (differing <= (F.col("n_a") + F.col("n_b")) * ((1 - share) / (1 + share)) + 1e-9)


def similar(edges: DataFrame, sets: DataFrame, share: float = SHARE) -> DataFrame:
    """The ``edges`` (``a``, ``b``) whose nodes' ``shingles`` in ``sets`` have a Jaccard similarity of ``share`` or more.

    Two empty sets are equal.
    """
    sizes = sets.select("node", F.size("shingles").alias("n"), "marks")
    sized = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    for end in ("a", "b"):
        sized = sized.join(sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("marks").alias(f"marks_{end}")), end)
    # Sizes and marks rule most others out, before the sets travel.
    fit = materialize(sized.where(may_be_similar(share)).select("a", "b", "n_a", "n_b"), "fitting")
    both = fit
    for end in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"s_{end}")), end)
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common >= (F.col("n_a") + F.col("n_b") - common) * share - 1e-9).select("a", "b")


def missed(members: DataFrame, groups: DataFrame, sure: DataFrame, sets: DataFrame, share: float = SHARE) -> DataFrame:
    """``(a, b)``: edges that complete ``sure`` among the nodes that share a cell of ``members`` with another of the ``groups``.

    ``members`` has ``cell`` and ``node``. Nodes of which all cells lie in one group have no such partner. The
    others are searched by prefixes, the rarest shingles of a set: of two sets that share ``share``, each holds one of the
    other's ``n - ceil(share * n) + 1`` rarest, in one order for all. So nothing is missed, and a line that many texts share is no key.

    First all holders of a prefix shingle are verified against its smallest holder, which joins most groups that belong
    together by as many rows as there are prefixes. Only what then is in different groups is met as pairs. A pair
    is a row at its first common shingles only (it is left out where both have the same one just before, as it was met there), and only if sizes and marks allow the similarity.
    """
    rooted = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("cell")
    opened = materialize(rooted.join(mixed, "cell").select("node", "root").distinct(), "open")
    own = materialize(sets.join(opened, "node"), "open-sets")
    tokens = own.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    # Only what nodes of two groups hold can link them; it is ordered by how many hold it.
    held = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    held = materialize(held, "held")
    ranked = tokens.join(held, "token")
    lists = ranked.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token", (F.col("lo") != F.col("hi")).alias("shared")))).alias("t"))
    prefix = F.slice("t", F.lit(1), (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"))
    found = lists.select("node", "n", F.filter(prefix, lambda t: t.shared).alias("t")).select("node", "n", F.transform("t", lambda t: t.token).alias("t"))
    before = lambda i: F.filter(F.array(*[F.get("t", i - k) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    placed = found.select("node", "n", F.explode(F.transform("t", lambda x, i: F.struct(x.alias("token"), before(i).alias("before")))).alias("p"))
    placed = materialize(placed.select("node", "n", "p.token", "p.before"), "prefixes")

    hubs = placed.groupBy("token").agg(F.min("node").alias("b"))
    stars = placed.select("token", F.col("node").alias("a")).join(hubs, "token").where("a != b").select("a", "b").distinct()
    own_roots = opened.select(F.col("node").alias("a"), F.col("root").alias("root_a")), opened.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    stars = stars.join(own_roots[0], "a").join(own_roots[1], "b").where("root_a != root_b").select("a", "b")
    joined = materialize(sure.union(similar(stars, own, share)), "joined")

    now = opened.select("node").join(components(joined), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = placed.join(now, "node")
    still = keyed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    keyed = materialize(keyed.join(still, "token", "left_semi").join(own.select("node", "marks"), "node"), "pairable")
    left, right = (keyed.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "before", "marks")]) for x in "ab")
    met_before = F.arrays_overlap("before_a", "before_b")
    pairs = left.join(right, "token").where((F.col("root_a") < F.col("root_b")) & ~met_before & may_be_similar(share))
    return joined.union(similar(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), own, share))


def drop_near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", how_many: int = 10, radius: int = 2, shingle: int = SHINGLE, share: float = SHARE
) -> DataFrame:
    """``docs`` with one document of each group of exact and near copies, all columns kept.

    Two texts are linked if a ``share`` of their word shingles is common (Jaccard similarity of the sets), and groups are what
    links connect. Candidates are texts of which any of ``how_many`` independent weighted word fingerprints differ in at most
    ``radius`` bits, and every candidate is verified on the shingles. One majority fingerprint of word shingles would miss
    most copies of which every twentieth word was changed; ten independent ones at two bits find nearly all.

    Copies of one fingerprint, and crowded cells, are verified against one of their members first. Cells that
    are not one group after that are searched exactly, so which member was chosen does not matter.

    The document with the smallest key stays, and of a repeated key the text with the smallest hash (of
    repeated rows one; null keys come last). Texts without words are copies of each other.
    """
    # Rows are told by key and text, as keys may be null or repeated with other texts.
    own = docs.withColumn("__digest", F.xxhash64(F.md5(text_of(text).cast("binary")), F.length(text_of(text))))
    made = with_fingerprints(own, [key, "__digest"], text, 1, how_many)
    # Equal texts are one row from here on; null keys come last.
    least = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__digest").alias("digest"))).alias("least")
    nodes = materialize(made.groupBy(F.col("__digest").alias("node")).agg(F.first("fps").alias("fps"), least), "classes")
    series = nodes.select("node", F.posexplode("fps").alias("series", "fp"))
    classes = materialize(series.groupBy("series", "fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "series")
    several = classes.where("n > 1").select("series", "fp", F.col("node").alias("b"), "n")
    same = join_counted(series, several, ["series", "fp"], "n").where("node != b").select(F.col("node").alias("a"), "b")
    edges = materialize(same.union(links(classes.drop("n"), radius)).distinct(), "candidates")
    # All texts of a linked fingerprint are met, not only the one that stands for it.
    met = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "met")
    # One row of equal texts per task travels, not every copy.
    one = own.groupBy("__digest").agg(F.first(text).alias(text))
    one = one.join(met.withColumnRenamed("node", "__digest").hint("merge"), "__digest", "left_semi")
    sets = materialize(with_shingles(one.withColumnRenamed("__digest", "node"), ["node"], text, shingle), "shingles")
    sure = materialize(similar(edges, sets, share), "sure")
    groups = materialize(components(sure), "groups")
    members = series.join(met, "node").select("node", F.explode(F.array(*cell_keys(radius))).alias("cell")).distinct()
    groups = components(missed(members, groups, sure, sets, share))
    rooted = nodes.select("least", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.key", "least.digest"), "kept")
    return _one_of_each(own, kept, key).select(*docs.columns)


def cell_keys(radius: int, blocks: int = BLOCKS) -> list[Column]:
    """Of a row with ``series`` and ``fp`` the keys of which fingerprints ``radius`` apart share one: all but ``radius`` blocks."""
    bounds = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in itertools.pairwise(bounds)]
    chosen = list(itertools.combinations(masks, blocks - radius))
    return [F.xxhash64(F.lit(n), F.col("series"), F.col("fp").bitwiseAND(F.lit(_signed(sum(c))))) for n, c in enumerate(chosen)]


def _one_of_each(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key and ``__digest`` are in ``kept`` (``key``, ``digest``); of equal ones the smallest row."""
    columns = docs.columns
    # The kept rows grow with the documents, so they are never sent to every task.
    chosen = kept.select(F.col("key").alias("__kept"), F.col("digest").alias("__kept_digest")).hint("merge")
    own = (F.col("__digest") == F.col("__kept_digest")) & F.col(key).eqNullSafe(F.col("__kept"))
    matched = docs.join(chosen, own, "left_semi")
    # Repeated rows are rare, so only they are sorted out.
    again = materialize(
        matched.groupBy(key, "__digest").count().where("count > 1").select(F.col(key).alias("__again"), F.col("__digest").alias("__again_digest")), "again"
    )
    if again.isEmpty():
        return matched
    repeated = (F.col("__digest") == F.col("__again_digest")) & F.col(key).eqNullSafe(F.col("__again"))
    once = matched.join(again, repeated, "left_anti")
    several = matched.join(again, repeated, "left_semi")
    first = several.groupBy(key, "__digest").agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*")
    return once.select(*columns).union(first.select(*columns))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and the group of near copies it is in."""
    return near_groups(table(spark, folder, "documents"))
