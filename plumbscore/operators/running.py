"""Running values along an order, spread over tasks even when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts each key in one task. That is kept for
keys of ordinary size. A key with more rows is cut into slices of the order column: a window
inside (key, slice) gives local values, a second window over one row per (key, slice) gives
what each slice takes over from the slices before or behind it, and joining the two is
exact. The cut points come from a sample, so they decide only how even the slices are,
never the result.

More than ``MAX_SLICES`` slices are cut in two levels: every slice is cut again by points of its own, and what
is taken over is summed per slice first and per part of a slice second. So neither the rows of a part nor the
list of cut points of a level grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from plumbscore.operators.joins import broadcast_if_small, join_same
from plumbscore.session import materialize

ROWS_PER_SLICE = 100_000
MAX_SLICES = 16_384
SAMPLED_ROWS_PER_SLICE = 100

CARRIED_BYTES = 256

_SLICE, _PART, _POSITION, _LARGE = "__slice", "__part", "__position", "__large"
_ORDINAL, _ONE = "__ordinal", "__one"
_KINDS = ("sum", "sum_before", "total", "last", "last_before", "next")


@dataclass(frozen=True)
class Running:
    """One running value.

    ``sum``/``sum_before``: sum up to this row, with or without it. ``total``: sum over the
    key. ``last``/``last_before``: latest non-null value up to this row, with or without it.
    ``next``: first non-null value from this row on.
    """

    name: str
    column: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"unknown kind {self.kind!r}, expected one of {_KINDS}")


def running(
    df: DataFrame,
    order: str,
    values: Sequence[Running],
    keys: Sequence[str] = (),
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    most_slices: int = MAX_SLICES,
) -> DataFrame:
    """``df`` plus one column per entry of ``values``, along ``order`` within ``keys``.

    ``order`` is a number or a time, not null, and unique within a key. ``df`` is written
    once to the shared folder. Keys of at most ``rows_per_slice`` rows take a plain window;
    larger ones are sliced, and beyond ``most_slices`` slices in two levels.

    Sums of whole numbers and decimals are the same in all forms. Sums of doubles are rounded in another order where a
    key is sliced: cast them to a decimal where that matters.
    """
    names = [v.name for v in values]
    table = materialize(df, "running")
    rows = table.count()
    limit = rows_per_slice
    if rows <= limit:
        return table.withColumns(_local(values, order, keys, descending))
    if keys:
        large = _large_keys(table, keys, limit)
        if large.isEmpty():
            return table.withColumns(_local(values, order, keys, descending))
        # There are fewer large keys than slices, so they are sent to all tasks only while they are few.
        marked = join_same(table, broadcast_if_small(large, CARRIED_BYTES), keys, "left")
    else:
        marked = table.withColumn(_LARGE, F.lit(True))

    sliced = _slice_rows(marked, order, rows if not keys else marked.where(_LARGE).count(), limit, most_slices)
    parts = [*keys, _SLICE, _PART] if _PART in sliced.columns else [*keys, _SLICE]
    split = sliced.where(_LARGE)
    carried = _handed_over(split, order, values, keys, descending)
    if _PART in parts:
        inner = _handed_over(split, order, values, [*keys, _SLICE], descending, _PART)
        carried = _both_levels(inner, carried, values, [*keys, _SLICE])
    carried = broadcast_if_small(carried, CARRIED_BYTES)
    # Without keys every total comes from the slices.
    wanted = [v for v in values if keys or v.kind != "total"]
    local = sliced.withColumns(_local(wanted, order, parts, descending))
    joined = join_same(local, carried, parts, "left")
    combined = [_combine(joined, v, v in wanted).alias(v.name) for v in values]
    return joined.select(*[c for c in df.columns if c not in names], *combined)


def rank_rows(
    df: DataFrame, ordering: Sequence[Column], name: str = "rank", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``df`` plus its 1-based rank in a total ``ordering`` of any types.

    A range-partitioned sort numbers the rows in increasing, gappy steps; running counts
    over those numbers close the gaps.
    """
    columns = df.columns
    numbered = df.orderBy(*ordering).withColumn(_ORDINAL, F.monotonically_increasing_id()).withColumn(_ONE, F.lit(1))
    ranked = running(numbered, _ORDINAL, [Running(name, _ONE, "sum")], rows_per_slice=rows_per_slice)
    return ranked.select(*columns, name)


def _numeric(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType.typeName()
    if kind == "timestamp_ntz":
        time = F.col(order)
        seconds = F.date_part(F.lit("SECOND"), time).cast("double")
        return F.unix_date(F.to_date(time)) * 86400.0 + F.hour(time) * 3600.0 + F.minute(time) * 60.0 + seconds
    if kind == "timestamp":
        return F.unix_micros(order).cast("double")
    if kind == "date":
        return F.unix_date(order).cast("double")
    return F.col(order).cast("double")


def _large_keys(table: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The keys with more than ``limit`` rows."""
    counted = table.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return materialize(counted.select(*keys, F.lit(True).alias(_LARGE)), "large-keys")


def _slice_rows(marked: DataFrame, order: str, rows: int, limit: int, most: int) -> DataFrame:
    """Number the slices of the ``rows`` rows of large keys by common cut points; other keys are one slice.

    The cuts split all rows of large keys evenly, so no (key, slice) is larger than a slice. More than ``most`` slices are
    that many with several parts each.
    """
    positioned = marked.withColumn(_POSITION, _numeric(marked, order))
    split_rows = positioned.where(_LARGE).select(_POSITION)
    wanted = math.ceil(rows / limit)
    slices = min(wanted, most)
    steps = [i / slices for i in range(1, slices)]
    sample = split_rows.sample(min(1.0, SAMPLED_ROWS_PER_SLICE * slices / rows), seed=17)
    found = sample.agg(F.percentile_approx(_POSITION, steps, 20 * slices).alias("cuts")).first()["cuts"] if steps else []
    cuts = sorted({c for c in found or [] if not math.isnan(c) and not math.isinf(c)})
    if not cuts:
        return positioned.withColumn(_SLICE, F.lit(0)).drop(_POSITION)
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=_POSITION, outputCol=_SLICE, handleInvalid="keep"
    )
    slice_number = F.when(F.col(_LARGE), F.col(_SLICE).cast("int")).otherwise(F.lit(0))
    numbered = bucketizer.transform(positioned).withColumn(_SLICE, slice_number)
    if wanted > most:
        numbered = _cut_again(numbered, rows, wanted, slices)
    return numbered.drop(_POSITION)


def _cut_again(numbered: DataFrame, rows: int, wanted: int, slices: int) -> DataFrame:
    """Number the parts of each slice, by cut points of its own from a sample of it."""
    parts = math.ceil(wanted / slices)
    steps = [i / parts for i in range(1, parts)]
    sample = numbered.where(_LARGE).sample(min(1.0, SAMPLED_ROWS_PER_SLICE * wanted / rows), seed=19)
    cuts = sample.groupBy(_SLICE).agg(F.percentile_approx(_POSITION, steps, 20 * parts).alias("__cuts"))
    cuts = broadcast_if_small(materialize(cuts, "cuts"), 8 * parts + CARRIED_BYTES)
    part = F.size(F.filter(F.array_distinct("__cuts"), lambda c: c <= F.col(_POSITION)))
    found = numbered.join(cuts, _SLICE, "left")
    return found.withColumn(_PART, F.when(F.col(_LARGE) & F.col("__cuts").isNotNull(), part).otherwise(F.lit(0))).drop("__cuts")


def _ordered(column: str, keys: Sequence[str], descending: bool) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col(column).desc() if descending else F.col(column).asc())


def _within(value: Running, order: str, keys: Sequence[str], descending: bool) -> Column:
    ahead = _ordered(order, keys, descending)
    here = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    if value.kind == "sum":
        return F.coalesce(F.sum(value.column).over(here), F.lit(0))
    if value.kind == "sum_before":
        return F.coalesce(F.sum(value.column).over(before), F.lit(0))
    if value.kind == "total":
        whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.sum(value.column).over(whole), F.lit(0))
    if value.kind == "last":
        return F.last(value.column, ignorenulls=True).over(here)
    if value.kind == "last_before":
        return F.last(value.column, ignorenulls=True).over(before)
    # A frame that reaches to the end of the partition is quadratic; the mirrored order is not.
    behind = _ordered(order, keys, not descending)
    return F.last(value.column, ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _local(
    values: Sequence[Running], order: str, parts: Sequence[str], descending: bool
) -> dict[str, Column]:
    return {value.name: _within(value, order, parts, descending) for value in values}


def _handed_over(
    sliced: DataFrame, order: str, values: Sequence[Running], keys: Sequence[str], descending: bool, number: str = _SLICE
) -> DataFrame:
    """One row per (large key, slice), at most as many per key as slices of a level, with the carried values."""
    aggregates = []
    for value in values:
        column = F.col(value.column)
        position = F.when(column.isNotNull(), F.col(order))
        if value.kind.startswith("sum") or value.kind == "total":
            summary = F.sum(column)
        elif (value.kind == "next") != descending:
            summary = F.min_by(column, position)
        else:
            summary = F.max_by(column, position)
        aggregates.append(summary.alias("__carry_" + value.name))
    table = sliced.groupBy(*keys, number).agg(*aggregates)

    carried = []
    for value in values:
        column = "__carry_" + value.name
        if value.kind == "total":
            found = F.coalesce(F.sum(column).over(Window.partitionBy(*keys)), F.lit(0))
        else:
            window = _ordered(number, keys, (value.kind == "next") != descending)
            window = window.rowsBetween(Window.unboundedPreceding, -1)
            found = (
                F.sum(column).over(window)
                if value.kind.startswith("sum")
                else F.last(column, ignorenulls=True).over(window)
            )
        carried.append(found.alias(column))
    return table.select(*keys, number, *carried)


def _both_levels(inner: DataFrame, outer: DataFrame, values: Sequence[Running], keys: Sequence[str]) -> DataFrame:
    """What a part takes over: from the parts of its slice, and from the slices before or behind that."""
    above = outer.select(*keys, *[F.col(f"__carry_{v.name}").alias(f"__above_{v.name}") for v in values])
    both, carried = join_same(inner, above, keys, "left"), []
    for value in values:
        own, more = _term(both, f"__carry_{value.name}"), _term(both, f"__above_{value.name}")
        if value.kind == "total":
            found = more
        elif value.kind.startswith("sum"):
            found = F.coalesce(own + more, own, more)
        else:
            found = F.coalesce(own, more)
        carried.append(found.alias(f"__carry_{value.name}"))
    return both.select(*keys, _PART, *carried)


def _term(df: DataFrame, name: str) -> Column:
    """A column to be added to another of its type: two decimals of 38 digits would lose one behind the point."""
    kind = df.schema[name].dataType
    return F.col(name).cast(DecimalType(min(kind.precision, 37), kind.scale)) if isinstance(kind, DecimalType) else F.col(name)


def _combine(df: DataFrame, value: Running, has_local: bool) -> Column:
    carried = F.col("__carry_" + value.name)
    if value.kind == "total":
        return F.coalesce(carried, F.col(value.name)) if has_local else carried
    if value.kind.startswith("sum"):
        own = _term(df, value.name)
        return F.coalesce(own + _term(df, "__carry_" + value.name), own)
    return F.coalesce(F.col(value.name), carried)
