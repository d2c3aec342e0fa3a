"""Squared-Euclidean silhouette and assignment to given centres."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbscore.operators.joins import BROADCAST_BYTES, broadcast_if_small, join_dealt, join_same
from plumbscore.session import materialize

UNROLLED_TERMS = 128
# The sums of a key beyond this size are measured in blocks, so that no row holds them all.
PACKED_BYTES = 64 * 1024
# A row meets all clusters of the few blocks that it reaches, but only the boxes of the others.
BLOCK_CLUSTERS = 64
# Rounding of a mean distance, as a share of the norms it is the difference of.
SLACK = 1e-9


def vector_columns(array: str, size: int) -> list[Column]:
    """The elements of an array column as double columns."""
    return [F.col(array)[i].cast("double") for i in range(size)]


def _doubles(features: Sequence[str | Column]) -> list[Column]:
    return [(F.col(f) if isinstance(f, str) else f).cast("double") for f in features]


def _total(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def nearest_centre(features: Sequence[str | Column], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the closest centre; the first of equally close ones."""
    columns = _doubles(features)
    distances = [
        F.struct(
            _total([(x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c in zip(columns, centre)]).alias("distance"),
            F.lit(index).alias("cluster"),
        )
        for index, centre in enumerate(centres)
    ]
    return (F.least(*distances) if len(distances) > 1 else distances[0])["cluster"]


def cluster_sums(
    df: DataFrame, features: Sequence[str | Column], cluster: str, keys: Sequence[str] = ()
) -> DataFrame:
    """``n``, feature sums ``s`` and summed squared norm ``q`` per key and cluster."""
    columns = _doubles(features)
    sums = [F.sum(x).alias(f"__s{i}") for i, x in enumerate(columns)]
    found = df.groupBy(*keys, F.col(cluster).alias("cluster")).agg(
        F.count("*").cast("double").alias("n"), F.sum(_total([x * x for x in columns])).alias("q"), *sums
    )
    return found.select(*keys, "cluster", "n", "q", F.array(*[f"__s{i}" for i in range(len(columns))]).alias("s"))


def vector_silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """``(rows, clusters, silhouette)`` of a whole table; null below two clusters.

    Runs Spark's evaluator on a vector column and a numeric cluster column. The evaluator brings the
    sums of all clusters to the driver; if they exceed ``PACKED_BYTES`` the rows are measured by
    :func:`silhouette` under one key instead. Rows without a cluster are left out; ``unclustered`` counts them.
    """
    table = df.where(F.col(cluster).isNotNull()).select(features, F.col(cluster).cast("double").alias(cluster))
    found = table.agg(F.count("*").alias("rows"), F.count_distinct(cluster).alias("clusters")).first()
    value = None
    # The width is read from one row: among the counts, the vectors would make Spark sort all rows to aggregate them.
    width = len(table.select(features).first()[0]) if found["clusters"] >= 2 else 0
    if found["clusters"] >= 2 and found["clusters"] * (width + 4) * 8 > PACKED_BYTES:
        arrays = table.select(vector_to_array(features).alias("__array"), cluster, F.lit(0).alias("__whole"))
        keyed = silhouette(arrays, vector_columns("__array", width), cluster, ["__whole"])
        value = keyed.first()["silhouette"]
    elif found["clusters"] >= 2:
        value = ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(table)
    return df.sparkSession.createDataFrame(
        [(found["rows"], found["clusters"], value)], "rows bigint, clusters bigint, silhouette double"
    )


def unclustered(df: DataFrame, cluster: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows per key that have no cluster."""
    return df.groupBy(*keys).agg(F.count_if(F.col(cluster).isNull()).alias("unclustered"))


def silhouette(
    df: DataFrame, features: Sequence[str | Column], cluster: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Mean silhouette per key, with ``rows`` and ``clusters``; null below two clusters.

    Two passes over the rows and no row pairs: the mean squared distance of x to a cluster
    is |x|^2 + q/n - 2 x.s/n, from the sums of that cluster. Where a key has very many clusters
    a row meets only those that can be the nearest. Without keys the whole table
    goes through :func:`vector_silhouette`. Rows without a cluster are left out whatever the
    number of clusters; ``unclustered`` counts them.
    """
    columns = _doubles(features)
    df = df.where(F.col(cluster).isNotNull())
    if not keys:
        return vector_silhouette(df.select(array_to_vector(F.array(*columns)).alias("features"), cluster), "features", cluster)

    sums = materialize(cluster_sums(df, features, cluster, keys), "cluster-sums")
    sizes = sums.groupBy(*keys).count().agg(F.sum("count"), F.max("count")).first()
    small, largest = ((size or 0) * (len(columns) + 4) * 8 for size in sizes)
    small = small <= BROADCAST_BYTES
    most = max(1, UNROLLED_TERMS // len(columns))
    labels = [r["cluster"] for r in sums.select("cluster").distinct().limit(most + 1).collect()]
    measure = _with_columns_per_cluster if len(labels) <= most else _with_cluster_array if largest <= PACKED_BYTES else _with_cluster_blocks
    slim = df.select(*keys, F.col(cluster).alias("__cluster"), F.array(*columns).alias("__x")).withColumn(
        "__xx", _total([F.col("__x")[i] * F.col("__x")[i] for i in range(len(columns))])
    )
    measured = measure(slim, sums, labels, len(columns), keys, small)
    score = (
        F.when(F.col("__n") == 1, 0.0)
        .when(F.col("__a") < F.col("__b"), 1 - F.try_divide(F.col("__a"), F.col("__b")))
        .when(F.col("__a") > F.col("__b"), F.try_divide(F.col("__b"), F.col("__a")) - 1)
        .otherwise(0.0)
    )
    found = measured.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.max("__clusters").cast("bigint").alias("clusters"), F.avg(score).alias("__mean")
    )
    return found.select(*keys, "rows", "clusters", F.when(F.col("clusters") >= 2, F.col("__mean")).alias("silhouette"))


def _mean_distance(entry: Column, size: int) -> Column:
    """Mean squared distance of a row to the cluster whose sums are in ``entry``."""
    if size <= UNROLLED_TERMS:
        dot = _total([F.col("__x")[i] * entry["s"][i] for i in range(size)])
    else:
        dot = F.aggregate(F.zip_with("__x", entry["s"], lambda x, s: x * s), F.lit(0.0), lambda total, part: total + part)
    return F.col("__xx") + (entry["q"] - 2.0 * dot) / entry["n"]


def _join_sums(slim: DataFrame, packed: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """One row of sums per key beside every row; broadcast when their size was found small."""
    return join_same(slim, F.broadcast(packed) if small else packed, keys)


def _with_columns_per_cluster(
    slim: DataFrame, sums: DataFrame, labels: Sequence, size: int, keys: Sequence[str], small: bool
) -> DataFrame:
    """``__n, __a, __b`` with one column per cluster, which compiles to straight code."""
    entry = F.struct("n", "q", "s")
    packed = sums.groupBy(*keys).agg(
        F.count("*").alias("__clusters"),
        *[F.max_by(entry, F.when(F.col("cluster") == label, 1)).alias(f"__c{i}") for i, label in enumerate(labels)],
    )
    rows = _join_sums(slim, packed, keys, small)
    own_n, own_distance, others = F.lit(None).cast("double"), F.lit(None).cast("double"), []
    for i, label in enumerate(labels):
        mine, sums_of = F.col("__cluster") == label, F.col(f"__c{i}")
        own_n = F.when(mine, sums_of["n"]).otherwise(own_n)
        own_distance = F.when(mine, F.col(f"__d{i}")).otherwise(own_distance)
        others.append(F.when(~mine, F.col(f"__d{i}")))
    nearest_other = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    distances = {f"__d{i}": _mean_distance(F.col(f"__c{i}"), size) for i in range(len(labels))}
    measured = rows.withColumns(distances).withColumns({"__n": own_n, "__own": own_distance, "__b": nearest_other})
    return measured.withColumn("__a", F.try_divide(F.col("__own") * F.col("__n"), F.col("__n") - 1))


def _with_cluster_array(
    slim: DataFrame, sums: DataFrame, labels: Sequence, size: int, keys: Sequence[str], small: bool
) -> DataFrame:
    """``__n, __a, __b`` from one array of all clusters, for many clusters or features."""
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "n", "q", "s")).alias("__all"))
    rows = _join_sums(slim, packed, keys, small).withColumns(
        {
            "__clusters": F.size("__all"),
            "__own": F.filter("__all", lambda e: e["cluster"] == F.col("__cluster"))[0],
            "__others": F.filter("__all", lambda e: e["cluster"] != F.col("__cluster")),
        }
    )

    def distance(entry: Column) -> Column:
        products = F.zip_with("__x", entry["s"], lambda x, s: x * s)
        dot = F.aggregate(products, F.lit(0.0), lambda total, part: total + part)
        return F.col("__xx") + (entry["q"] - 2.0 * dot) / entry["n"]

    return rows.withColumns(
        {
            "__n": F.col("__own.n"),
            "__a": F.try_divide(distance(F.col("__own")) * F.col("__own.n"), F.col("__own.n") - 1),
            "__b": F.array_min(F.transform("__others", distance)),
        }
    )


def _ends_below(value: Column) -> Column:
    """How many of the array ``__ends`` are at most ``value``."""
    return F.coalesce(F.size(F.filter("__ends", lambda end: end <= value)), F.lit(0))


def _cluster_blocks(sums: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """``sums`` plus ``block``, ``strip``, ``near`` (the sums of a cluster close by) and ``__clusters`` of the key.

    Blocks are the cells, and strips the columns, of a quantile grid over the two features in which the centres differ most, of about
    ``BLOCK_CLUSTERS`` clusters or the square root of all. Cells that equal centres fill beyond that are split by a hash. The
    cluster close by is the nearer neighbour within the block, ordered by the first of these features; a cluster alone in its
    block gets any other of the key.
    """
    spread = sums.agg(*[F.var_pop(F.col("s")[i] / F.col("n")).alias(str(i)) for i in range(size)]).first()
    wide = sorted(range(size), key=lambda i: -spread[i] if spread[i] is not None and math.isfinite(spread[i]) else 0.0)[:2]
    most = sums.groupBy(*keys).count().agg(F.max("count")).first()[0]
    target = max(BLOCK_CLUSTERS, math.isqrt(most))
    cuts = math.ceil((most / target) ** (1 / len(wide)))
    shares = [j / cuts for j in range(1, cuts)] or [0.5]
    placed, cell = sums, list(keys)
    for level, i in enumerate(wide):
        value = F.col("s")[i] / F.col("n")
        ends = placed.groupBy(*cell).agg(F.percentile_approx(value, shares).alias("__ends"))
        placed = join_same(placed, ends, cell).withColumn(f"__cut{level}", _ends_below(value)).drop("__ends")
        cell.append(f"__cut{level}")
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("__size"))
    part = F.pmod(F.xxhash64("cluster"), F.ceil(F.col("__size") / F.lit(2 * target)))
    block = F.xxhash64(*cell[len(keys) :], part).alias("block")
    strip = F.col(cell[len(keys)]).alias("strip")
    entry = F.struct("n", "q", "s")
    blocks = materialize(join_same(placed, sizes, cell).select(*keys, "cluster", "n", "q", "s", block, strip), "cluster-blocks")

    order = Window.partitionBy(*keys, "block").orderBy(F.col("s")[wide[0]] / F.col("n"), "cluster")
    beside = blocks.withColumns({"__before": F.lag(entry).over(order), "__after": F.lead(entry).over(order)})
    beside = beside.withColumns({"__x": F.transform("s", lambda x: x / F.col("n")), "__xx": F.lit(0.0)})
    nearer = _mean_distance(F.col("__before"), size) <= _mean_distance(F.col("__after"), size)
    beside = beside.withColumn("near", F.when(nearer, F.col("__before")).otherwise(F.coalesce("__after", "__before")))
    near = beside.select(*blocks.columns, "near")
    ends = blocks.groupBy(*keys).agg(
        F.count("*").alias("__clusters"), F.min("cluster").alias("least"), F.min_by(entry, "cluster").alias("lo"), F.max_by(entry, "cluster").alias("hi")
    )
    known = join_same(near, ends, keys)
    any_other = F.when(F.col("__clusters") > 1, F.when(F.col("cluster") == F.col("least"), F.col("hi")).otherwise(F.col("lo")))
    return known.select(*blocks.columns, F.coalesce("near", any_other).alias("near"), "__clusters")


def _with_cluster_blocks(
    slim: DataFrame, sums: DataFrame, labels: Sequence, size: int, keys: Sequence[str], small: bool
) -> DataFrame:
    """``__n, __a, __b`` for so many clusters that no row should meet them all.

    The mean distance to a cluster is the squared distance to its centre plus its variance. So the clusters of a block are at
    least as far as the box around their centres plus their least variance (and so for the blocks of a strip), and a row meets
    the clusters of a block only if that is less than its distance to the cluster close to its own. Bounds give way by the rounding of the distances,
    so the minimum is exact. Rows of large clusters and of blocks that many rows meet are dealt to slices.
    """
    slim = materialize(slim.withColumn("__id", F.monotonically_increasing_id()), "cluster-rows")
    blocks = materialize(_cluster_blocks(sums, size, keys), "cluster-near")
    own = blocks.withColumnRenamed("cluster", "__cluster").drop("block", "strip")
    counts = own.select(*keys, "__cluster", F.col("n").cast("bigint").alias("count"))
    nearby, far = _mean_distance(F.col("near"), size), F.lit(float("inf"))
    rows = join_dealt(slim, own, counts, [*keys, "__cluster"], "__id").withColumns(
        {"__own": _mean_distance(F.struct("n", "q", "s"), size), "__limit": F.coalesce(nearby, far)}
    )
    mean_to_others = F.try_divide(F.col("__own") * F.col("n"), F.col("n") - 1)
    rows = rows.select(*slim.columns, "__clusters", F.col("n").alias("__n"), mean_to_others.alias("__a"), "__limit")
    sides = range(min(size, UNROLLED_TERMS))
    centre = [F.col("s")[i] / F.col("n") for i in range(size)]
    variance = F.col("q") / F.col("n") - _total([c * c for c in centre])
    boxes = blocks.groupBy(*[F.col(k).alias(f"__box_{k}") for k in keys], F.col("strip").alias("__box_strip"), "block").agg(
        F.min(variance).alias("__least"),
        F.max(F.col("q") / F.col("n")).alias("__most"),
        *[F.min(centre[i]).alias(f"__lo{i}") for i in sides],
        *[F.max(centre[i]).alias(f"__hi{i}") for i in sides],
    )
    boxes = materialize(boxes, "cluster-boxes")
    strips = boxes.groupBy(*[f"__box_{k}" for k in keys], "__box_strip").agg(
        F.min("__least").alias("__least"),
        F.max("__most").alias("__most"),
        *[F.min(f"__lo{i}").alias(f"__lo{i}") for i in sides],
        *[F.max(f"__hi{i}").alias(f"__hi{i}") for i in sides],
    )
    # Plain columns and few terms: Java leaves a method of more than 8000 bytes uncompiled, and a long condition makes one.
    gaps = []
    for i in sides:
        x, lo, hi = F.col(f"__x{i}"), F.col(f"__lo{i}"), F.col(f"__hi{i}")
        gaps.append(F.when(x < lo, (lo - x) * (lo - x)).when(x > hi, (x - hi) * (x - hi)).otherwise(0.0))
    # A box around centres that are no numbers rules nothing out.
    reached = F.nanvl(_total(gaps) + F.col("__floor"), F.lit(0.0)) < F.col("__reach")
    rows = materialize(rows, "cluster-limits")
    reach = (F.col("__limit") + SLACK * F.col("__xx")).alias("__reach")
    kept = [*keys, "__id", "__cluster", "__xx", "__limit", reach, *[F.col("__x")[i].alias(f"__x{i}") for i in sides]]
    opened = rows.select(*kept, *(["__x"] if size > UNROLLED_TERMS else []))
    columns = opened.columns
    same = [F.col(k).eqNullSafe(F.col(f"__box_{k}")) for k in keys]
    # The box around a strip of blocks holds theirs, so a row looks only into the strips that it reaches.
    bytes_per_box = (2 * len(sides) + 4) * 8
    for level, alike in ((strips, same), (boxes, [*same, F.col("strip").eqNullSafe(F.col("__box_strip"))])):
        found = reached
        for match in alike:
            found = found & match
        box = level.withColumn("__floor", F.col("__least") - SLACK * F.col("__most")).drop("__least", "__most")
        more = [F.col("__box_strip").alias("strip")] if level is strips else ["block"]
        opened = opened.join(broadcast_if_small(box, bytes_per_box), found).select(*columns, *more)
    # |x|^2 + q/n - x.(2s/n) from plain columns: a pair takes no division, and no array is written or read.
    unrolled = size <= UNROLLED_TERMS
    point = [f"__x{i}" for i in sides] if unrolled else ["__x"]
    opened = materialize(opened.select(*keys, "block", "__id", "__cluster", "__xx", "__limit", *point), "cluster-reached")
    counts = materialize(opened.groupBy(*keys, "block").count(), "cluster-reach")
    if unrolled:
        weights = [(2.0 * F.col("s")[i] / F.col("n")).alias(f"__w{i}") for i in sides]
        centres = blocks.select(*keys, "block", "cluster", (F.col("q") / F.col("n")).alias("__base"), *weights)
        distance = F.col("__xx") + (F.col("__base") - _total([F.col(f"__x{i}") * F.col(f"__w{i}") for i in sides]))
    else:
        centres = blocks.select(*keys, "block", "cluster", "n", "q", "s")
        distance = _mean_distance(F.struct("n", "q", "s"), size)
    met = join_dealt(opened, centres, counts, [*keys, "block"], "__id")
    closer = met.where((F.col("cluster") != F.col("__cluster")) & (distance < F.col("__limit")))
    best = closer.groupBy("__id").agg(F.min(distance).alias("__best"))
    nearest = F.least(F.coalesce("__best", far), "__limit")
    return rows.join(best, "__id", "left").withColumn("__b", F.when(nearest < far, nearest))
