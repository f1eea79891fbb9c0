"""Run matrix, comparison families, histories, epoch selection, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import set_fingerprint
from .prefix import lookup_join

#: What determines a run's weights.  ``source`` belongs to it, ``selection`` does not.
CONFIG = ("fs", "arm", "notch", "source", "seed")
METRICS = ("macro_all", "macro_clean")


def duplicate_configs(runs: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """Runs whose configuration occurs more than once: ``(config…, n_runs, run_id)``.

    Long form, so a configuration with many runs is never gathered.
    """
    counts = runs.groupBy(*config).agg(F.count(F.lit(1)).alias("n_runs")).where(F.col("n_runs") > 1)
    return lookup_join(runs.select(*config, "run_id"), counts, config, "n_runs")


def replicate_pairs(runs: DataFrame, config: Sequence[str] = CONFIG) -> DataFrame:
    """Runs of one configuration in two blocks.

    A block holds a configuration once (anything else is an error), so pairs per
    configuration are bounded by the pairs of blocks.
    """
    a = runs.groupBy(*config, "block").agg(F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("a configuration repeats inside a block"))).otherwise(F.col("run_id"))
    per = a.groupBy(*config).agg(F.sort_array(F.collect_list(F.struct("block", once.alias("run_id")))).alias("bs"))
    pairs = F.flatten(F.transform("bs", lambda x, i: F.transform(
        F.slice("bs", i + 2, F.size("bs")),
        lambda z: F.struct(
            x["block"].alias("block_a"), x["run_id"].alias("run_a"),
            z["block"].alias("block_b"), z["run_id"].alias("run_b"),
        ),
    )))
    return per.where(F.size("bs") > 1).select(*config, F.inline(pairs))


def families(runs: DataFrame) -> DataFrame:
    """``(analysis, family, grp, run_id)`` for the four comparisons of the design."""
    block, fs = F.col("block"), F.col("fs")
    entry = lambda cond, analysis, family, grp: F.when(
        cond, F.struct(F.lit(analysis).alias("analysis"), family.alias("family"), grp.alias("grp"))
    )
    rate = fs.cast("string")
    arms = fs.isin(240, 250, 500)
    uses = F.array(
        entry(block == 1, "rates", F.lit("rates"), rate),
        entry((block == 1) & arms, "arms", F.concat(F.lit("arms@"), rate), F.lit("A")),
        entry((block == 2) & arms, "arms", F.concat(F.lit("arms@"), rate), F.lit("B")),
        entry((block == 1) & (fs == 100), "notch", F.lit("notch@100"), F.lit("with")),
        entry(block == 3, "notch", F.lit("notch@100"), F.lit("without")),
        entry(block == 3, "source", F.lit("source@100"), F.lit("resampled")),
        entry(block == 4, "source", F.lit("source@100"), F.lit("distributed")),
    )
    return runs.select("run_id", "seed", F.inline(F.filter(uses, lambda u: u.isNotNull()))).select(
        "analysis", "family", "grp", "run_id", "seed"
    )


def family_completeness(declared: DataFrame, available: DataFrame) -> DataFrame:
    """Declared and missing runs per family; a family is usable only when nothing is missing."""
    have = available.select("run_id").distinct().withColumn("_have", F.lit(1))
    return declared.join(have, "run_id", "left").groupBy("analysis", "family").agg(
        F.count(F.lit(1)).alias("n_declared"),
        F.count(F.when(F.col("_have").isNull(), 1)).alias("n_missing"),
    ).withColumn("complete", F.col("n_missing") == 0)


def refuse_incomplete(declared: DataFrame, available: DataFrame) -> DataFrame:
    """The declared runs; fails if any has no predictions."""
    missing = declared.join(available.select("run_id").distinct(), "run_id", "left_anti")
    few = [r["run_id"] for r in missing.select("run_id").distinct().orderBy("run_id").take(5)]
    if few:
        raise ValueError(f"runs without predictions, first: {few}")
    return declared


def source_guards(requests: DataFrame, rates: Sequence[int], distributed: str = "lr", distributed_fs: int = 100) -> DataFrame:
    """Why a ``(fs, notch, source)`` request is refused; ``ok`` when it is not."""
    fs, lr = F.col("fs"), F.col("source") == distributed
    reason = (
        F.when(~fs.isin(*rates), F.lit("rate_not_in_protocol"))
        .when(~F.col("source").isin("hr", distributed), F.lit("unknown_source"))
        .when(lr & (fs != distributed_fs), F.lit("distributed_source_at_other_rate"))
        .when(lr & F.col("notch"), F.lit("distributed_source_with_notch"))
        .otherwise(F.lit("ok"))
    )
    return requests.withColumn("status", reason)


# --- alignment of predictions -----------------------------------------------------------

def alignment_report(preds: DataFrame, reference_run: str, expected: DataFrame | None = None) -> DataFrame:
    """Per run: cells absent from it, cells only in it, label disagreements.

    One full outer join against the reference run's cells; runs cover the same
    records with the same labels exactly when all three counts are 0.
    """
    cells = ["record_id", "label"]
    base = preds.where(F.col("run_id") == reference_run).select(*cells, F.col("y").alias("y0"))
    per_cell = preds.select("run_id", *cells, "y").join(base, cells, "left")
    total = base.agg(F.count(F.lit(1)).alias("n0"))
    return (
        per_cell.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count(F.when(F.col("y0").isNull(), 1)).alias("n_extra"),
            F.count(F.when(F.col("y") != F.col("y0"), 1)).alias("n_label_mismatch"),
        )
        .join(F.broadcast(total))  # one row
        .select(
            "run_id", "n_cells", (F.col("n0") - (F.col("n_cells") - F.col("n_extra"))).alias("n_absent"),
            "n_extra", "n_label_mismatch",
        )
        .withColumn("aligned", (F.col("n_absent") == 0) & (F.col("n_extra") == 0) & (F.col("n_label_mismatch") == 0))
    )


def refuse_misaligned(preds: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """The predictions; fails on duplicate cells, different records, labels or frozen sets."""
    first = preds.agg(F.min("run_id")).first()[0]
    if first is None:
        raise ValueError("no predictions")
    twice = preds.groupBy("run_id", "record_id", "label").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"duplicate prediction cell: {twice[0].asDict()}")
    bad = [r["run_id"] for r in alignment_report(preds, first).where(~F.col("aligned")).take(5)]
    if bad:
        raise ValueError(f"runs not aligned with {first}: {bad}")
    if frozen is not None:
        per_run = frozen.groupBy("run_id").agg(set_fingerprint("label").alias("fp"))
        if per_run.select("fp").distinct().count() > 1:
            raise ValueError("runs use different frozen label sets")
    return preds


# --- histories ----------------------------------------------------------------------------

def _defined(c: str) -> Column:
    v = F.col(c)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)


def best_epochs(history: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """First epoch at the maximum of each metric, undefined values losing.

    ``max`` over ``(value, -epoch)`` structs combines on the map side; a metric
    undefined everywhere selects the first epoch.
    """
    top = lambda m: F.max(
        F.struct(F.coalesce(_defined(m), F.lit(float("-inf"))).alias("v"), (-F.col("epoch")).alias("e"))
    )["e"]
    return history.groupBy("run_id").agg(*[(-top(m)).alias(f"best_{m}") for m in metrics])


def epoch_selection(history: DataFrame, chosen: Column, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Selected epoch per run with the counterfactual of the other criterion.

    ``chosen`` gives the metric that selects, per run.
    """
    best = best_epochs(history, metrics).withColumn("selection", chosen)
    picked = F.coalesce(*[F.when(F.col("selection") == m, F.col(f"best_{m}")) for m in metrics])
    agree = F.lit(True)
    for m in metrics[1:]:
        agree = agree & (F.col(f"best_{m}") == F.col(f"best_{metrics[0]}"))
    rows = best.select("run_id", "selection", *[f"best_{m}" for m in metrics], picked.alias("epoch"), agree.alias("criteria_agree"))
    return rows.join(history.select("run_id", "epoch", *metrics), ["run_id", "epoch"]).withColumnRenamed(
        "epoch", "selected_epoch"
    )


def replicate_drift(history: DataFrame, pairs: DataFrame, metrics: Sequence[str] = ("train_loss", *METRICS)) -> DataFrame:
    """Largest per-epoch difference of paired runs, and epochs that agree exactly."""
    side = lambda s: history.select(
        F.col("run_id").alias(f"run_{s}"), "epoch", *[F.col(m).alias(f"{m}_{s}") for m in metrics]
    )
    both = pairs.select("run_a", "run_b").join(side("a"), "run_a").join(side("b"), ["run_b", "epoch"])
    gap = lambda m: F.abs(F.col(f"{m}_a") - F.col(f"{m}_b"))
    return both.groupBy("run_a", "run_b").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        *[F.max(gap(m)).alias(f"max_{m}") for m in metrics],
        *[F.count(F.when(gap(m) == 0, 1)).alias(f"exact_{m}") for m in metrics],
    )


# --- provenance ------------------------------------------------------------------------------

def record_fingerprint(records: DataFrame, key: str = "record_id", by: Sequence[str] = ()) -> DataFrame:
    """Fingerprint of the set of records, per group if asked."""
    agg = [set_fingerprint(key).alias("fingerprint"), F.count(F.lit(1)).alias("n_records")]
    return records.groupBy(*by).agg(*agg) if by else records.agg(*agg)


def config_fingerprint(runs: DataFrame, parts: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """16 hex digits over the canonical JSON of ``parts`` in name order.

    The caller leaves out what may change without changing results: the epoch
    count and the worker count.
    """
    payload = F.to_json(F.struct(*[F.col(p) for p in sorted(parts)]))
    return runs.withColumn(name, F.substring(F.sha2(payload, 256), 1, 16))


def run_summary(runs: DataFrame, endpoints: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """One report row per run: configuration, endpoints, defined labels."""
    out = runs.join(endpoints, "run_id")
    return out if support is None else out.join(support, "run_id", "left")
