"""Tie-aware ranking metrics over long predictions ``(keys…, y, score)``.

Rows collapse to distinct scores before any ordering, which makes ties exact,
absorbs hot scores on the map side and gives weighted metrics for free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .prefix import RANGE, lookup_join, range_cuts, range_layout, running, with_range

WIDE = "decimal(38,0)"
#: Below this many ranges (about a billion distinct scores) and up to this many cells pair counts of a group fit a BIGINT.
BIGINT_RANGES = 2_000
BIGINT_CELLS = 1 << 32
DEFAULT_KEYS = ("run_id", "label")


def undefined(score: str) -> Column:
    return F.col(score).isNull() | F.isnan(F.col(score).cast("double"))


def known_score() -> Column:
    """The score; a NULL or NaN one is refused, with cuts and without."""
    return F.when(undefined("score"), F.raise_error(F.lit("a score is undefined"))).otherwise(F.col("score")).alias("score")


def collapse(preds: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Class totals per distinct score: ``(keys, score, pos, neg)``; a NULL or NaN score is refused."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return preds.withColumn("score", known_score()).groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("y") > 0, w).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col("y") > 0, zero).otherwise(w)).alias("neg"),
    )


def collapse_wide(wide: DataFrame, scores: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """:func:`collapse` of a wide table ``(labels…, scores…)`` by ``(run_id, label)``: one run per score column.

    The labels of a row share its scores, so equal scores are counted once for all of them.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    rows = wide.unpivot(list(labels), list(scores), "run_id", "score").withColumn("score", known_score())
    counts = rows.groupBy("run_id", "score").agg(
        F.sum(one).alias("_n"), *[F.sum(F.when(F.col(c) > 0, one).otherwise(zero)).alias(c) for c in labels]
    )
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("pos"), (F.col("_n") - F.col(c)).alias("neg")) for c in labels])
    return counts.select("run_id", "score", F.inline(each)).select("run_id", "label", "score", "pos", "neg")


def auroc_from_counts(u2: Column, n_pos: Column, n_neg: Column) -> Column:
    """``U / (n+ n-)`` from twice the Mann-Whitney count; NULL with one class."""
    return F.when(
        (n_pos > 0) & (n_neg > 0),
        u2.cast("double") / (F.lit(2.0) * n_pos.cast("double") * n_neg.cast("double")),
    )


def pair_counts(
    preds: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    weight: str | None = None,
    cuts: Sequence[float] | None = None,
    combine: bool | None = None,
) -> DataFrame:
    """``(keys, n_pos, n_neg, u2)`` with ``u2`` = twice the Mann-Whitney count.

    ``u2`` splits exactly over score ranges: pairs inside a range, plus positives
    of the range times negatives of the lower ranges.  So no row needs a global
    offset and the scan reads the collapsed table once.

    ``combine=False`` says that scores rarely repeat: where groups are small
    (no cuts) rows then move once, by key, instead of by score and again by key.
    Cuts and ``combine`` come from a sketch of the scores unless given.
    """
    keys = list(keys)
    if cuts is None:
        cuts, repeats = range_layout(preds, "score")
        combine = repeats if combine is None else combine
    if combine is False and not cuts:
        return _pair_counts_direct(preds, keys, weight)
    table = collapse(preds, keys, weight)
    if cuts:
        table = with_range(table, "score", cuts)
    scope = keys + ([RANGE] if cuts else [])
    below = Window.partitionBy(*scope).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        table.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
        .groupBy(*scope)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("u2"),
        )
    )
    if not cuts:
        return per
    return across_ranges(per, keys)


def across_ranges(per: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals ``(keys, n_pos, n_neg, u2)`` from counts per score range, pairs across ranges included."""
    lower = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("n_neg").over(lower), F.lit(0)).cast("decimal(18,0)")
    cross = (F.col("n_pos").cast("decimal(18,0)") * carried * 2).cast(WIDE)
    return (
        per.withColumn("u2", F.col("u2").cast(WIDE) + cross)
        .groupBy(*keys)
        .agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("u2").alias("u2"))
    )


def _pair_counts_direct(preds: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    """One shuffle and one sort for groups that fit a task.

    Pairs with negative <= positive, plus all pairs less those with positive <=
    negative, count a win twice and a tie once.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = preds.select(
        *keys, known_score(), F.when(F.col("y") > 0, w).otherwise(zero).alias("pos"),
        F.when(F.col("y") > 0, zero).otherwise(w).alias("neg"),
    )
    upto = Window.partitionBy(*keys).orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    scan = rows.withColumns({"neg_le": F.sum("neg").over(upto), "pos_le": F.sum("pos").over(upto)})
    return scan.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * F.col("neg_le") - F.col("neg") * F.col("pos_le")).alias("_d"),
    ).select(*keys, "n_pos", "n_neg", (F.col("_d") + F.col("n_pos") * F.col("n_neg")).alias("u2"))


def auroc(
    preds: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    weight: str | None = None,
    cuts: Sequence[float] | None = None,
    combine: bool | None = None,
) -> DataFrame:
    """Per-group AUROC ``(keys, n_pos, n_neg, auroc)``; NULL when one class is absent."""
    counts = pair_counts(preds, keys, weight, cuts, combine)
    return counts.select(
        *keys, "n_pos", "n_neg",
        auroc_from_counts(F.col("u2"), F.col("n_pos"), F.col("n_neg")).alias("auroc"),
    )


def label_scores(
    preds: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    weight: str | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """AUROC and step-wise average precision per group from one descending scan.

    Both are NULL unless both classes are present, also when every row is positive.
    """
    return scores_of_counts(collapse(preds, keys, weight), keys, cuts)


def scores_of_counts(table: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, cuts: Sequence[float] | None = None) -> DataFrame:
    """:func:`label_scores` from the class totals per distinct score that :func:`collapse` or :func:`collapse_wide` gives.

    With ranges the totals are written: the sketch and both sides of the scan read
    them, and an exchange above an unpivot is not reused.  ``cuts=()`` is one scan
    for groups that fit a task.
    """
    keys = list(keys)
    few = True
    if cuts is None or cuts:
        table = written(table, "totals")
        few = (table.agg(F.sum(F.col("pos").cast("decimal(18,0)") + F.col("neg"))).first()[0] or 0) <= BIGINT_CELLS
        cuts = range_cuts(table, "score") if cuts is None else cuts
    scan = running(table, keys, "score", ["pos", "neg"], cuts, descending=True)
    tp = F.col("before_pos") + F.col("pos")
    fp = F.col("before_neg") + F.col("neg")
    step = F.col("pos") * tp.cast("double") / (tp + fp)
    wins = 2 * F.col("before_pos") + F.col("pos")
    if few and len(cuts) < BIGINT_RANGES:
        pairs = F.col("neg") * wins
    else:
        pairs = F.col("neg").cast("decimal(18,0)") * wins.cast("decimal(19,0)")
    sums = scan.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(pairs).alias("u2"),
        F.sum(step).alias("ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *keys, "n_pos", "n_neg",
        auroc_from_counts(F.col("u2"), F.col("n_pos"), F.col("n_neg")).alias("auroc"),
        F.when(both, F.col("ap") / F.col("n_pos")).alias("auprc"),
    )


def midranks(
    rows: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``midrank``: 1-based rank with ties averaged; NULL, and no part of the ranking, where the score is NULL or NaN."""
    keys = list(keys)
    cuts = range_cuts(rows, score) if cuts is None else cuts
    ties = rows.where(~undefined(score)).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(ties, keys, score, ["_n"], cuts).withColumn(
        "midrank", F.col("before__n") + (F.col("_n") + 1) / 2.0
    )
    return lookup_join(rows, ranks.drop("before__n"), [*keys, score], "_n", unmatched=undefined(score)).drop("_n")


def accuracy_at(
    preds: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    weight: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Share of rows on the right side of ``threshold``; one map-side-combined pass."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    right = (F.col("score") >= threshold) == (F.col("y") > 0)
    return preds.groupBy(*keys).agg(
        (F.sum(F.when(right, w).otherwise(0)) / F.sum(w)).alias("accuracy")
    )


# --- macro figures ---------------------------------------------------------------

def macro(scores: DataFrame, by: Sequence[str], value: str = "auroc", frozen: str | None = None) -> DataFrame:
    """Means over defined labels: ``macro_all`` and, with a flag column, ``macro_clean``."""
    cols = [F.avg(value).alias("macro_all"), F.count(value).alias("n_defined")]
    if frozen:
        kept = F.when(F.col(frozen), F.col(value))
        cols += [F.avg(kept).alias("macro_clean"), F.count(kept).alias("n_defined_clean")]
    return scores.groupBy(*by).agg(*cols)


def mark_frozen(scores: DataFrame, frozen: DataFrame) -> DataFrame:
    """Flag the labels of the frozen set; Spark broadcasts it if its size allows."""
    names = frozen.select("label").distinct().withColumn("_f", F.lit(True))
    return scores.join(names, "label", "left").withColumn("frozen", F.coalesce("_f", F.lit(False))).drop("_f")


def defined_fraction(scores: DataFrame, by: Sequence[str], frozen: str | None = None) -> DataFrame:
    """Share of labels that have both classes, and how many those are."""
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    cols = [
        F.avg(ok.cast("double")).alias("defined_fraction"),
        F.count(F.when(ok, 1)).alias("n_defined"),
    ]
    if frozen:
        cols.append(F.count(F.when(ok & F.col(frozen), 1)).alias("n_defined_clean"))
    return scores.groupBy(*by).agg(*cols)


# --- scores before ranking ------------------------------------------------------

def crop_mean(crops: DataFrame, keys: Sequence[str] = ("run_id", "record_id", "label"),
              n_crops: int = 4) -> DataFrame:
    """Mean *probability* over the crops of a record.

    Fails when a record does not have exactly ``n_crops`` crops or its label
    changes between them.
    """
    mean = F.avg("score")
    grouped = crops.groupBy(*keys).agg(
        mean.alias("score"),
        F.count(F.lit(1)).alias("n_crops"),
        F.min("y").alias("_y0"),
        F.max("y").alias("_y1"),
    )
    checked = (
        F.when(F.col("n_crops") != n_crops, F.raise_error(F.lit("unexpected crop count")))
        .when(F.col("_y0") != F.col("_y1"), F.raise_error(F.lit("label changes between crops")))
        .otherwise(F.col("_y0"))
    )
    return grouped.select(*keys, checked.alias("y"), "score", "n_crops")


def ensemble(preds: DataFrame, group: str = "grp", family: Sequence[str] = ()) -> DataFrame:
    """Mean probability over the seeds of a group, per record and label; seeds that disagree on ``y`` are refused."""
    agreed = F.when(F.min("y") == F.max("y"), F.max("y")).when(F.count("y") > 0, F.raise_error(F.lit("runs disagree on a label")))
    return preds.groupBy(*family, group, "record_id", "label").agg(
        agreed.alias("y"), F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_seeds")
    )


def seed_dispersion(per_run: DataFrame, group: str = "grp", value: str = "macro_all") -> DataFrame:
    """Range and sample standard deviation over seeds; both 0 for a single seed."""
    return per_run.groupBy(group).agg(
        F.count(value).alias("n_seeds"),
        F.avg(value).alias("seed_mean"),
        (F.max(value) - F.min(value)).alias("seed_spread"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("seed_std"),
    )


def label_breakdown(scores: DataFrame, a: str, b: str, group: str = "grp") -> DataFrame:
    """Per-label difference between two groups (exploratory)."""
    left = scores.where(F.col(group) == a).select("label", F.col("auroc").alias("auroc_a"), "n_pos")
    right = scores.where(F.col(group) == b).select("label", F.col("auroc").alias("auroc_b"))
    return left.join(right, "label").select(
        "label", "n_pos", "auroc_a", "auroc_b", (F.col("auroc_a") - F.col("auroc_b")).alias("diff")
    )
