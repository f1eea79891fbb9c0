"""Null contrasts, the pre-set verdict on the largest difference, the reproduction gate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .inference import crosses_zero, endpoint_values
from .ranking import auroc_from_counts, pair_counts

# Thresholds set before the study, and the pair without expected effect.
GAP_TYPICAL = 0.006
GAP_LARGEST = 0.019
GATE_TARGET = 0.941
GATE_TOLERANCE = 0.010
NEGATIVE_CONTROL = ("240", "250")


def half_subsets(n: int) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """Subsets of size ``n // 2`` and the unordered pairs of disjoint ones."""
    if n < 2:
        return [], []
    subsets = list(combinations(range(n), n // 2))
    disjoint = [
        (i, j) for i, j in combinations(range(len(subsets)), 2) if not set(subsets[i]) & set(subsets[j])
    ]
    return subsets, disjoint


def null_contrasts(
    preds: DataFrame, n_seeds: int, frozen: DataFrame | None = None, group: str = "grp", seed: str = "seed",
    family: Sequence[str] = (),
) -> DataFrame:
    """Ensemble differences inside a group ``(family…, grp, endpoint, left, right, value)``.

    Seeds split into two disjoint subsets of equal size: with five seeds, fifteen
    pairs of 2 against 2.  Every subset ensemble comes from one pass over the
    predictions; only macro figures, a few per group, are paired.
    """
    subsets, disjoint = half_subsets(n_seeds)
    keys = [*family, group]
    if not subsets:
        return endpoint_values(
            preds.withColumn("auroc", F.lit(None).cast("double")), keys, frozen
        ).where(F.lit(False)).select(
            *keys, "endpoint", F.lit(0).alias("left"), F.lit(0).alias("right"), "value"
        )
    by_seed = preds.groupBy(*keys, "record_id", "label").agg(
        F.max("y").alias("y"),
        F.sort_array(F.collect_list(F.struct(F.col(seed).alias("s"), F.col("score").alias("v")))).alias("seeds"),
    )
    checked = F.when(
        F.size("seeds") != n_seeds, F.raise_error(F.lit(f"a group does not have {n_seeds} seeds"))
    ).otherwise(F.col("seeds"))
    scores = by_seed.withColumn("seeds", checked)
    means = F.array(*[
        F.struct(
            F.lit(i).alias("subset"),
            (sum((F.col("seeds")[k]["v"] for k in members), F.lit(0.0)) / len(members)).alias("score"),
        )
        for i, members in enumerate(subsets)
    ])
    exploded = scores.select(*keys, "record_id", "label", "y", F.inline(means))
    counts = pair_counts(exploded, [*keys, "subset", "label"])
    scored = counts.withColumn("auroc", auroc_from_counts(F.col("u2"), F.col("n_pos"), F.col("n_neg")))
    values = endpoint_values(scored, [*keys, "subset"], frozen)
    lists = values.groupBy(*keys, "endpoint").agg(
        F.map_from_entries(F.collect_list(F.struct("subset", "value"))).alias("m")
    )
    pairs = F.array(*[
        F.struct(
            F.lit(i).alias("left"), F.lit(j).alias("right"), (F.col("m")[i] - F.col("m")[j]).alias("value")
        )
        for i, j in disjoint
    ])
    return lists.select(*keys, "endpoint", F.inline(pairs))


def matching_factor(n_seeds) -> Column:
    """Scale from subset ensembles to full ones; reported, never applied."""
    n = n_seeds if isinstance(n_seeds, Column) else F.lit(n_seeds)
    return F.when(n >= 2, F.sqrt(F.floor(n / 2) / n))


def null_medians(contrasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median absolute contrast; drop the group from ``by`` to pool the groups."""
    return contrasts.groupBy(*by).agg(
        F.expr("percentile(abs(value), 0.5)").alias("null_median"), F.count(F.lit(1)).alias("n_contrasts")
    )


def tag_negative_control(pairs: DataFrame, pair: tuple[str, str] = NEGATIVE_CONTROL) -> DataFrame:
    return pairs.withColumn("negative_control", (F.col("a") == pair[0]) & (F.col("b") == pair[1]))


def verdict(magnitude: Column, crosses: Column, comparator: Column) -> Column:
    """Detectable first, size second."""
    return (
        F.when(crosses | (magnitude <= comparator), F.lit("not_detectable"))
        .when(magnitude < GAP_TYPICAL, F.lit("below_typical_gap"))
        .when(magnitude < GAP_LARGEST, F.lit("comparable_to_reported_gaps"))
        .otherwise(F.lit("exceeds_any_gap"))
    )


def interpret_delta(pairs: DataFrame, pooled: DataFrame, dispersion: DataFrame, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Verdict on the largest absolute difference of each family.

    ``pooled`` holds the pooled null median per family, ``dispersion`` the seed
    spread per group.  Without a null contrast the comparator falls back to the
    largest seed spread and says so.
    """
    by = list(by)
    size = F.abs(F.col("diff"))
    row = F.struct("a", "b", "diff", "lo", "hi", "lo_simultaneous", "hi_simultaneous", "p_holm")
    # the first pair in (a, b) order wins equal magnitudes
    ranked = F.struct(size.alias("size"), F.struct("a", "b").alias("ab"), row.alias("row"))
    top = pairs.where(F.col("diff").isNotNull()).groupBy(*by).agg(
        F.max(size).alias("delta_abs"), F.collect_list(ranked).alias("all")
    )
    best = F.array_sort(F.filter("all", lambda x: x["size"] == F.col("delta_abs")))[0]["row"]
    spread = dispersion.groupBy(*by).agg(
        F.max("seed_spread").alias("max_seed_spread"), F.max("seed_std").alias("max_seed_std"),
        F.max("n_seeds").alias("n_seeds"),
    )
    joined = top.select(*by, "delta_abs", best.alias("r")).select(*by, "delta_abs", "r.*").join(
        spread, by, "left"
    ).join(pooled.select(*by, "null_median"), by, "left")
    comparator = F.coalesce("null_median", "max_seed_spread", F.lit(0.0))
    return joined.select(
        *by, "a", "b", F.col("diff").alias("delta"), "delta_abs", "lo", "hi", "lo_simultaneous", "hi_simultaneous",
        "p_holm", crosses_zero().alias("crosses_zero"),
        F.when(F.col("null_median").isNotNull(), "null_contrast").otherwise("seed_spread").alias("comparator"),
        comparator.alias("comparator_value"),
        (F.col("null_median") * matching_factor(F.col("n_seeds"))).alias("null_contrast_matched"),
        "max_seed_spread", "max_seed_std",
        verdict(F.col("delta_abs"), crosses_zero(), comparator).alias("verdict"),
    )


def gate_verdict(estimates: DataFrame, target: float = GATE_TARGET, tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """Both reproduction conditions, reported apart and together."""
    inside = (F.col("lo") <= target) & (F.col("hi") >= target)
    near = F.abs(F.col("point") - target) <= tolerance
    return estimates.withColumns({
        "difference": F.col("point") - target,
        "ci_contains_target": inside,
        "point_within_tolerance": near,
        "accepted": inside & near,
    })
