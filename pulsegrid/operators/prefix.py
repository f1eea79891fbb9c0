"""Ordered scans inside groups of any size.

``Window.partitionBy(group).orderBy(value)`` puts a whole group in one task.
Everything that needs an ordered running total here goes through
:func:`running` instead: values are cut into ranges, each ``(group, range)``
gets its own window, and the small table of range totals supplies the offsets.
The cuts are literals in the plan, so a lost executor recomputes identical
ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.exprs import as_col
from ..session import written

RANGE = "_range"
ROWS_PER_RANGE = 500_000
MAX_RANGES = 65_536
SKETCH_GROUPS = 512
SKETCH_POINTS = 1_024
SKETCH_SHARE = 0.02


class Layout(NamedTuple):
    """How to scan a column: cut points, and whether its values repeat often."""

    cuts: tuple[float, ...]
    repeats: bool


def range_layout(
    df: DataFrame,
    column: str,
    rows_per_range: int = ROWS_PER_RANGE,
    max_ranges: int = MAX_RANGES,
) -> Layout:
    """Cut points that split ``column`` into ranges of about equal row counts.

    One pass over one column, sketching a share of it.  At most
    ``SKETCH_GROUPS`` quantile sketches of ``SKETCH_POINTS`` values reach the
    driver whatever the input size, and no reducer merges more than its share of
    the map-side sketches.  The layout steers balance only; results do not depend
    on it.  Small inputs get no cuts.
    """
    probs = [(i + 0.5) / SKETCH_POINTS for i in range(SKETCH_POINTS)]
    value = as_col(column).cast("double")
    sketches = (
        df.select(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"), value.alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .sample(SKETCH_SHARE, seed=0)
        .groupBy("g")
        .agg(
            F.count(F.lit(1)).alias("n"), F.approx_count_distinct("v").alias("d"),
            F.percentile_approx("v", probs, 4 * SKETCH_POINTS).alias("q"),
        )
        .collect()
    )
    seen = sum(r["n"] for r in sketches)
    repeats = sum(r["d"] for r in sketches) < seen / 2
    wanted = min(max_ranges, math.ceil(seen / SKETCH_SHARE / rows_per_range))
    if wanted <= 1:
        return Layout((), repeats)
    points = np.concatenate([np.asarray(r["q"], dtype=float) for r in sketches])
    mass = np.concatenate([np.full(len(r["q"]), r["n"] / len(r["q"])) for r in sketches])
    order = np.argsort(points, kind="stable")
    reached = np.cumsum(mass[order])
    at = np.searchsorted(reached, np.arange(1, wanted) * (seen / wanted))
    return Layout(tuple(float(v) for v in np.unique(points[order][np.minimum(at, len(order) - 1)])), repeats)


def range_cuts(df: DataFrame, column: str, **limits: int) -> tuple[float, ...]:
    return range_layout(df, column, **limits).cuts


def with_range(df: DataFrame, column: str, cuts: Sequence[float], descending: bool = False) -> DataFrame:
    """Add the range number of ``column``; numbers follow the requested order.

    As in a sort, NULL is below and NaN above all other values.
    """
    splits = [-math.inf, *cuts, math.inf]
    value = as_col(column).cast("double")
    bucketed = (
        Bucketizer(splits=splits, inputCol="_v", outputCol="_r")
        .transform(df.withColumn("_v", F.when(F.isnan(value), F.lit(math.inf)).otherwise(value)))
    )
    # declared non-null, so no filter separates the two uses of the input below
    number = F.coalesce(F.col("_r").cast("int"), F.lit(0))
    if descending:
        number = F.lit(len(cuts)) - number
    return bucketed.withColumn(RANGE, number).drop("_v", "_r")


def _ordered(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    cuts: Sequence[float] = (),
    *,
    descending: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add ``before_<c>``: the sum of ``c`` over the rows of the group that precede.

    ``df`` must hold one row per ``(keys, order)`` and no NULL key.  ``totals``
    also adds ``all_<c>``, the group sum.
    """
    keys = list(keys)
    cut = bool(cuts)
    base = with_range(df, order, cuts, descending) if cut else df
    scope = keys + ([RANGE] if cut else [])
    part = scope or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(_ordered(order, descending)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*part)
    local = base
    for c in sums:
        local = local.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(before), F.lit(0)))
        if totals and not cut:
            local = local.withColumn(f"all_{c}", F.sum(c).over(whole))
    if not cut:
        return local

    per_range = base.groupBy(*scope).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    group = keys or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    entire = Window.partitionBy(*group)
    offsets = per_range.select(
        *scope,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *([F.sum(f"_sum_{c}").over(entire).alias(f"all_{c}") for c in sums] if totals else []),
    )
    # both sides read the same exchange, which Spark computes once
    out = local.join(offsets, scope)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"_off_{c}"))
    return out.drop(RANGE, *[f"_off_{c}" for c in sums])


def dense_index(df: DataFrame, key: str, name: str = "idx", cuts: Sequence[float] | None = None) -> DataFrame:
    """Number the rows 0..n-1 in the order of a unique ``key`` of any orderable type.

    Numbers go by score ranges where ``key`` is a number, else by range partitions:
    those are written, since a recomputed sample could draw other borders, and the
    counts of the partitions give the offsets.
    """
    if cuts is None and not isinstance(df.schema[key].dataType, T.NumericType):
        return _index_by_partition(df, key, name)
    cuts = range_cuts(df, key) if cuts is None else cuts
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (
        running(ones, [], key, ["_one"], cuts)
        .withColumnRenamed("before__one", name)
        .drop("_one")
    )


#: ``monotonically_increasing_id`` holds the partition above this bit, the row's place in it below.
_PLACE_BITS = 33


def _index_by_partition(df: DataFrame, key: str, name: str) -> DataFrame:
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), "numbered"
    ).withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.join(offsets, "_part").withColumn(name, F.col("_off") + place).drop("_at", "_part", "_off")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles ``(keys, p, q)`` of groups of any size.

    Equal values collapse first, so neither a hot value nor a hot group lands in
    one task.  NULL values are skipped.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    cuts = range_cuts(known, value) if cuts is None else cuts
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    scanned = running(counts, keys, value, ["n"], cuts, totals=True)
    asked = scanned.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = (F.col("all_n") - 1) * F.col("p")
    low, high = F.floor(pos), F.ceil(pos)
    last = F.col("before_n") + F.col("n") - 1
    return (
        asked.where((F.col("before_n") <= high) & (last >= low))
        .groupBy(*keys, "p")
        .agg(
            F.max(F.when((F.col("before_n") <= low) & (last >= low), F.col(value))).alias("_lo"),
            F.max(F.when((F.col("before_n") <= high) & (last >= high), F.col(value))).alias("_hi"),
            F.max(pos - low).alias("_f"),
        )
        .select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("q"))
    )


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    count_col: str,
    hot_rows: int = 5_000_000,
    salts: int = 64,
    unmatched: Column | None = None,
) -> DataFrame:
    """Join rows to a table that is unique on ``keys`` when some keys are hot.

    With ``unmatched``, a flag of rows that have no key in the lookup, all rows
    stay; those flagged are spread, however many share a key.

    ``count_col`` of the lookup says how many rows carry the key.  Keys above
    ``hot_rows`` number at most ``rows / hot_rows``, so that list may be
    broadcast; their rows spread over ``salts`` copies of the lookup row.
    """
    keys = list(keys)
    hot = lookup.where(F.col(count_col) > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = (
        rows.withColumn("_spread", spread)
        .join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot") if unmatched is None else F.col("_hot") | unmatched, F.col("_spread")).otherwise(0))
        .drop("_hot", "_spread")
    )
    copies = F.when(F.col(count_col) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = lookup.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"], "inner" if unmatched is None else "left").drop("_salt")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, cuts: Sequence[float] = (), name: str = "top"
) -> DataFrame:
    """Add the running maximum of ``value`` up to and including each row.

    ``df`` must hold one row per ``(keys, order)``.
    """
    keys = list(keys)
    cut = bool(cuts)
    base = with_range(df, order, cuts) if cut else df
    scope = keys + ([RANGE] if cut else [])
    so_far = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = base.withColumn(name, F.max(value).over(so_far))
    if not cut:
        return local
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = base.groupBy(*scope).agg(F.max(value).alias("_m")).select(
        *scope, F.max("_m").over(earlier).alias("_carried")
    )
    return local.join(carried, scope).withColumn(name, F.greatest(name, "_carried")).drop(RANGE, "_carried")
