"""The comparison of a whole design as one job: gates, then one resample for all its families.

Everything that could make a comparison meaningless is checked before a draw is
used: every declared run has predictions, all runs cover the same records with
the same labels, no cell is given twice, and the frozen label sets agree.  What
the checks need is one mergeable aggregate per run, so they cost one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import set_fingerprint
from ..session import written
from . import decisions, inference
from .experiments import families, refuse_incomplete
from .ranking import auroc

FAMILY = ("analysis", "family")
#: Fixed value: the block of the design whose runs must reproduce the published figure.
BLOCKING_BLOCK = 0


class Analysis(NamedTuple):
    """Pairs of groups, groups, and the verdict on the largest difference, per family and endpoint."""

    pairs: DataFrame
    groups: DataFrame
    verdicts: DataFrame


def run_populations(preds: DataFrame) -> DataFrame:
    """``(run_id, n_cells, population, labelling)`` from one aggregate that merges in any order.

    ``population`` identifies the set of (record, label) cells, ``labelling`` that
    with the label's value.  Repeated cells are found in the ensemble, see :func:`refuse_repeated`.
    """
    return preds.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        set_fingerprint("record_id", "label").alias("population"),
        set_fingerprint("record_id", "label", "y").alias("labelling"),
    )


def refuse_unequal(populations: DataFrame, frozen_sets: DataFrame | None = None) -> DataFrame:
    """The runs' fingerprints; fails unless all runs cover the same records with the same labels.

    ``populations`` comes from :func:`run_populations`; ``frozen_sets`` is ``(run_id,
    label)``, the frozen labels each run was evaluated with.
    """
    first = populations.agg(F.min_by(F.struct("run_id", "population", "labelling"), "run_id").alias("r")).first()["r"]
    if first is None:
        raise ValueError("no predictions")
    other = F.when(F.col("population") != first["population"], F.lit("records")).when(F.col("labelling") != first["labelling"], F.lit("labels"))
    bad = populations.withColumn("_what", other).where("_what is not null").select("run_id", "_what").orderBy("run_id").take(5)
    if bad:
        raise ValueError(f"runs not aligned with {first['run_id']}: {[(r['run_id'], r['_what']) for r in bad]}")
    if frozen_sets is not None:
        per_run = frozen_sets.groupBy("run_id").agg(set_fingerprint("label").alias("fp"))
        if per_run.select("fp").distinct().count() > 1:
            raise ValueError("runs use different frozen label sets")
    return populations


def refuse_repeated(cells: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ensemble; fails if a cell of it holds more or fewer scores than its group has runs."""
    size = declared.groupBy(*keys).agg(F.count_distinct("run_id").alias("_runs"))
    wrong = cells.groupBy(*keys).agg(F.min("n_seeds").alias("_lo"), F.max("n_seeds").alias("_hi")).join(size, list(keys))
    bad = wrong.where("_lo <> _runs or _hi <> _runs").take(1)
    if bad:
        raise ValueError(f"duplicate or missing prediction cell in {bad[0].asDict()}")
    return cells


def _gated(preds: DataFrame, declared: DataFrame, frozen_sets: DataFrame | None) -> DataFrame:
    """Predictions of the declared runs, after the gates; the order of the gates is that of the message a user needs first."""
    used = preds.join(declared.select("run_id").distinct(), "run_id", "left_semi")
    populations = written(run_populations(used), "populations")
    refuse_incomplete(declared, populations)
    refuse_unequal(populations, frozen_sets)
    return used


def analyse(
    preds: DataFrame, runs: DataFrame, frozen: DataFrame, analyses: Sequence[str] | None = None, n_boot: int = 10_000, seed: int = 0,
    alpha: float = 0.05, n_seeds: int = 5, frozen_sets: DataFrame | None = None,
) -> Analysis:
    """All families that ``runs`` declares (:func:`pulsegrid.operators.experiments.families`), or those of ``analyses``.

    One ensemble per group, one bootstrap for all families and endpoints, written
    once; Holm and the simultaneous level stay inside a family and endpoint.
    """
    family = list(FAMILY)
    keys = [*family, "grp"]
    declared = families(runs)
    if analyses is not None:
        declared = declared.where(F.col("analysis").isin(*analyses))
    declared = written(declared, "declared")
    if not declared.take(1):
        raise ValueError("no runs in the families asked for")
    used = _gated(preds, declared, frozen_sets)
    scored = used.select("run_id", "record_id", "label", "y", "score")
    members = scored.join(declared, "run_id")

    cells = written(inference.ensemble(members, "grp", family), "ensemble")
    refuse_repeated(cells, declared, keys)
    draws = inference.draws_of(cells, keys, frozen, n_boot, seed)
    pairs = decisions.tag_negative_control(inference.compare_draws(draws, family, alpha))

    null = decisions.null_contrasts(members, n_seeds, frozen, family=family)
    per_run = inference.endpoint_values(auroc(scored, ["run_id", "label"]), ["run_id"], frozen)
    spread = per_run.join(declared, "run_id").groupBy(*keys, "endpoint").agg(
        (F.max("value") - F.min("value")).alias("seed_spread"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("seed_std"),
        F.count("value").alias("n_seeds"),
    )
    medians = decisions.null_medians(null, [*keys, "endpoint"]).select(*keys, "endpoint", "null_median")
    groups = inference.describe_draws(draws, family, alpha).join(spread, [*keys, "endpoint"]).join(medians, [*keys, "endpoint"], "left")
    pooled = decisions.null_medians(null, [*family, "endpoint"])
    return Analysis(pairs, groups, decisions.interpret_delta(pairs, pooled, spread, by=[*family, "endpoint"]))


def stage0_gate(
    preds: DataFrame, runs: DataFrame, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05, block: int = BLOCKING_BLOCK,
    target: float = decisions.GATE_TARGET, tolerance: float = decisions.GATE_TOLERANCE,
) -> DataFrame:
    """Whether the blocking runs reproduce the published macro AUROC over all labels: one row.

    The mean over the seeds, its record-level interval, the spread between seeds
    beside it, both conditions and what follows.
    """
    declared = runs.where(F.col("block") == block).select("run_id", "seed", F.lit("stage0").alias("analysis"), F.lit("stage0").alias("grp"))
    if not declared.take(1):
        raise ValueError(f"no run in block {block}")
    used = _gated(preds, declared, None)
    members = used.select("run_id", "record_id", "label", "y", "score").join(declared.select("run_id", "grp"), "run_id")
    refuse_repeated(inference.ensemble(members), declared, ["grp"])
    estimate = inference.seed_mean(members, None, n_boot, seed, alpha)
    runs_used = declared.agg(F.sort_array(F.collect_set("run_id")).alias("run_ids"))  # the few runs of one block
    return decisions.gate_verdict(estimate, target, tolerance).drop("grp").join(F.broadcast(runs_used))
