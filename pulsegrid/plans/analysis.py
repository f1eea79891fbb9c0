"""Queries: the comparison of the whole design and its blocking gate, each as one job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, inference, ranking
from ..functions.exprs import set_fingerprint
from ..operators.prefix import Layout
from ..session import scratch_dir
from ..sources import manifests
from . import bindings as b
from .registry import ENSEMBLE, N_BOOT, ap_cte, auroc_cte, query, rnd, weighted_ap_cte, weighted_auroc_cte, weights_cte, with_
from .runs import _fp_sql

GATE_POINT = 0.8
_SCOPE = "analysis, family, endpoint"

_MEMBERS = """
fam AS (
  SELECT 'rates' AS analysis, 'rates' AS family, fs::VARCHAR AS grp, run_id, seed FROM design WHERE block = 1
  UNION ALL SELECT 'arms', 'arms@' || fs, CASE WHEN block = 1 THEN 'A' ELSE 'B' END, run_id, seed FROM design WHERE block IN (1, 2) AND fs <> 100
  UNION ALL SELECT 'notch', 'notch@100', CASE WHEN block = 1 THEN 'with' ELSE 'without' END, run_id, seed FROM design WHERE block = 3 OR block = 1 AND fs = 100
  UNION ALL SELECT 'source', 'source@100', CASE WHEN block = 3 THEN 'resampled' ELSE 'distributed' END, run_id, seed FROM design WHERE block IN (3, 4)),
mem AS (SELECT analysis, family, grp, seed, run_id, record_id, label, y, score FROM pred_d JOIN fam USING (run_id)),
ens AS (SELECT analysis, family, grp, record_id, label, max(y) AS y, avg(score) AS score FROM mem GROUP BY ALL)"""

_PAIRS = with_(
    b.DESIGN_RUNS, b.PRED_D, b.FROZEN_S, _MEMBERS, weights_cte("ens"),
    "wens AS (SELECT rep, analysis, family, grp, label, y, score, w FROM ens JOIN weights USING (record_id))",
    weighted_auroc_cte("wens", "rep, analysis, family, grp, label"), auroc_cte("ens", "analysis, family, grp, label"),
    """
pts AS (
  SELECT rep, analysis, family, grp, label, auroc FROM wsc UNION ALL SELECT -1, analysis, family, grp, label, auroc FROM sc),
val AS (
  SELECT rep, analysis, family, grp, 'macro_all' AS endpoint, avg(auroc) AS value FROM pts GROUP BY ALL
  UNION ALL
  SELECT rep, analysis, family, grp, 'macro_clean', avg(auroc) FILTER (label IN (SELECT label FROM frozen_s)) FROM pts GROUP BY ALL),
pair AS (
  SELECT x.rep, analysis, family, endpoint, x.grp AS a, z.grp AS b, x.value - z.value AS value
  FROM val x JOIN val z USING (rep, analysis, family, endpoint) WHERE x.grp < z.grp),
raw AS (
  SELECT analysis, family, endpoint, a, b, count(value) AS n_defined, quantile_cont(value, 0.025::DOUBLE) AS lo, quantile_cont(value, 0.975::DOUBLE) AS hi,
         least(1.0::DOUBLE, 2.0::DOUBLE * (least(count(*) FILTER (value <= 0), count(*) FILTER (value >= 0)) + 1) / (count(value) + 1)) AS p_raw,
         list_sort(list(value)) AS v
  FROM pair WHERE rep >= 0 GROUP BY ALL),
step AS (
  SELECT *, count(*) OVER f AS m, (count(*) OVER f - row_number() OVER (PARTITION BY analysis, family, endpoint ORDER BY p_raw, a, b) + 1) * p_raw AS s
  FROM raw WINDOW f AS (PARTITION BY analysis, family, endpoint)),
cmp AS (
  SELECT step.*, least(1.0::DOUBLE, max(s) OVER (PARTITION BY step.analysis, step.family, step.endpoint ORDER BY p_raw, step.a, step.b)) AS p_holm, d.value AS diff
  FROM step JOIN (SELECT * FROM pair WHERE rep = -1) d
  ON d.analysis = step.analysis AND d.family = step.family AND d.endpoint = step.endpoint AND d.a = step.a AND d.b = step.b)""",
)

#: Linear-interpolation quantile of the sorted list ``v`` at level ``p``.
_AT = "(v[floor((len(v) - 1) * {p})::INT + 1] + (v[least(floor((len(v) - 1) * {p})::INT + 2, len(v))] - v[floor((len(v) - 1) * {p})::INT + 1]) * ((len(v) - 1) * {p} - floor((len(v) - 1) * {p})))"
_LOW, _HIGH = _AT.format(p="(0.05::DOUBLE / m / 2)"), _AT.format(p="(1.0::DOUBLE - 0.05::DOUBLE / m / 2)")
_COLS = ("diff", "lo", "hi", "p_raw", "p_holm", "lo_simultaneous", "hi_simultaneous")


def _run(spark, sf):
    return analysis.analyse(b.pred_d(spark, sf), b.design_runs(spark, sf), b.frozen_s(spark, sf), n_boot=N_BOOT, n_seeds=b.SEEDS)


@query("analyse", _PAIRS + f"""
SELECT {_SCOPE}, a, b, round(diff, 8) AS diff, round(lo, 8) AS lo, round(hi, 8) AS hi, round(p_raw, 8) AS p_raw, round(p_holm, 8) AS p_holm,
       round({_LOW}, 8) AS lo_simultaneous, round({_HIGH}, 8) AS hi_simultaneous, n_defined,
       a = '240' AND b = '250' AS negative_control, lo <= 0 AND hi >= 0 AS crosses_zero, p_holm < 0.05 AS significant FROM cmp""")
def analyse(spark, sf):
    return _run(spark, sf).pairs.withColumns({c: rnd(c) for c in _COLS})


_NULL = """
sub AS (SELECT m FROM range(1, 32) t(m) WHERE bit_count(m::INT) = 2),
sube AS (
  SELECT analysis, family, grp, m AS subset, record_id, label, max(y) AS y, avg(score) AS score
  FROM mem JOIN sub ON (m >> seed) & 1 = 1 GROUP BY ALL)"""
_NULL_VALUES = """
nv AS (
  SELECT analysis, family, grp, subset, 'macro_all' AS endpoint, avg(auroc) AS value FROM nsc GROUP BY ALL
  UNION ALL
  SELECT analysis, family, grp, subset, 'macro_clean', avg(auroc) FROM nsc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
pool AS (
  SELECT analysis, family, endpoint, median(abs(x.value - z.value)) AS c FROM nv x JOIN nv z USING (analysis, family, grp, endpoint)
  WHERE x.subset & z.subset = 0 AND x.subset < z.subset GROUP BY ALL)"""
_SPREAD = """
rv AS (
  SELECT analysis, family, grp, run_id, 'macro_all' AS endpoint, avg(auroc) AS value FROM rsc GROUP BY ALL
  UNION ALL
  SELECT analysis, family, grp, run_id, 'macro_clean', avg(auroc) FROM rsc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
sp AS (
  SELECT analysis, family, endpoint, max(spread) AS max_seed_spread, max(std) AS max_seed_std FROM (
    SELECT analysis, family, grp, endpoint, max(value) - min(value) AS spread, coalesce(stddev_samp(value), 0) AS std FROM rv GROUP BY ALL) GROUP BY ALL),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis, family, endpoint ORDER BY abs(diff) DESC, a, b) AS rn FROM cmp) WHERE rn = 1)"""


@query("analyse_verdicts", _PAIRS.rstrip() + ", " + ",\n".join(c.strip() for c in (
    _NULL, auroc_cte("sube", "analysis, family, grp, subset, label", "nsc"), _NULL_VALUES, auroc_cte("mem", "analysis, family, grp, run_id, label", "rsc"), _SPREAD,
)) + f"""
SELECT {_SCOPE}, a, b, round(diff, 8) AS delta, round(lo, 8) AS lo, round(hi, 8) AS hi, round(p_holm, 8) AS p_holm,
       lo <= 0 AND hi >= 0 AS crosses_zero, 'null_contrast' AS comparator, round(c, 8) AS comparator_value,
       round(c * sqrt(0.4::DOUBLE), 8) AS null_contrast_matched, round(max_seed_spread, 8) AS max_seed_spread, round(max_seed_std, 8) AS max_seed_std,
       CASE WHEN (lo <= 0 AND hi >= 0) OR abs(diff) <= c THEN 'not_detectable'
            WHEN abs(diff) < 0.006 THEN 'below_typical_gap'
            WHEN abs(diff) < 0.019 THEN 'comparable_to_reported_gaps' ELSE 'exceeds_any_gap' END AS verdict
FROM top JOIN pool USING (analysis, family, endpoint) JOIN sp USING (analysis, family, endpoint)""")
def analyse_verdicts(spark, sf):
    return _run(spark, sf).verdicts.select(
        *_SCOPE.split(", "), "a", "b", rnd("delta"), rnd("lo"), rnd("hi"), rnd("p_holm"), "crosses_zero", "comparator",
        rnd("comparator_value"), rnd("null_contrast_matched"), rnd("max_seed_spread"), rnd("max_seed_std"), "verdict",
    )


@query("stage0_gate", with_(
    b.DESIGN_RUNS, b.PRED_D, "g AS (SELECT * FROM pred_d WHERE block = 0)", weights_cte("g"),
    "wg AS (SELECT rep, run_id, label, y, score, w FROM g JOIN weights USING (record_id))",
    weighted_auroc_cte("wg", "rep, run_id, label"), auroc_cte("g", "run_id, label"), """
dr AS (SELECT rep, avg(v) AS v FROM (SELECT rep, run_id, avg(auroc) AS v FROM wsc GROUP BY ALL) GROUP BY rep),
ci AS (SELECT count(v) AS n_defined, quantile_cont(v, 0.025::DOUBLE) AS lo, quantile_cont(v, 0.975::DOUBLE) AS hi FROM dr),
pt AS (
  SELECT avg(v) AS point, count(*) AS n_seeds, max(v) - min(v) AS seed_spread, stddev_samp(v) AS seed_std, list_sort(list(run_id)) AS run_ids
  FROM (SELECT run_id, avg(auroc) AS v FROM sc GROUP BY ALL))""") + f"""
SELECT round(point, 8) AS point, round(lo, 8) AS lo, round(hi, 8) AS hi, n_defined, n_seeds, round(seed_spread, 8) AS seed_spread,
       round(seed_std, 8) AS seed_std, round(point - {GATE_POINT}, 8) AS difference, lo <= {GATE_POINT} AND hi >= {GATE_POINT} AS ci_contains_target,
       abs(point - {GATE_POINT}) <= 0.01 AS point_within_tolerance,
       lo <= {GATE_POINT} AND hi >= {GATE_POINT} AND abs(point - {GATE_POINT}) <= 0.01 AS accepted, array_to_string(run_ids, ',') AS run_ids FROM ci, pt""")
def stage0_gate(spark, sf):
    out = analysis.stage0_gate(b.pred_d(spark, sf), b.design_runs(spark, sf), N_BOOT, target=GATE_POINT)
    return out.select(
        rnd("point"), rnd("lo"), rnd("hi"), "n_defined", "n_seeds", rnd("seed_spread"), rnd("seed_std"), rnd("difference"),
        "ci_contains_target", "point_within_tolerance", "accepted", F.concat_ws(",", "run_ids").alias("run_ids"),
    )


@query("scan_run_manifests", with_(
    b.DESIGN_RUNS, f"recs AS (SELECT {_fp_sql('doc_id::VARCHAR')} AS fp, count(*) FILTER (doc_id % 10 < 8) AS n_train, count(*) FILTER (doc_id % 10 = 8) AS n_val FROM labels)",
) + """
SELECT run_id, block, fs, arm, notch, source, seed::INT AS seed, CASE WHEN block = 0 THEN 'macro_all' ELSE 'macro_clean' END AS selection,
       1 AS version, 100 AS epochs, CASE WHEN block = 0 THEN fs ELSE 500 END AS scaler_fs, fp AS fingerprint, n_train AS n_train_records, n_val AS n_val_records,
       false AS reduced_run FROM design, recs""")
def scan_run_manifests(spark, sf):
    path = scratch_dir(spark, "runs")
    ids = b.table(spark, sf, "labels").select("doc_id")
    recs = ids.agg(
        set_fingerprint("doc_id").alias("fingerprint"), F.count_if(F.col("doc_id") % 10 < 8).alias("n_train_records"),
        F.count_if(F.col("doc_id") % 10 == 8).alias("n_val_records"),
    )
    selection = F.when(F.col("block") == 0, "macro_all").otherwise("macro_clean")
    run = F.struct("run_id", "block", "fs", "arm", "notch", "source", "seed", selection.alias("selection"))
    train = F.struct(F.lit(100).alias("epochs"), F.lit(64).alias("batch_size"), F.lit(0.001).alias("lr"), F.lit(0.001).alias("weight_decay"))
    scaler = F.struct(F.when(F.col("block") == 0, F.col("fs")).otherwise(500).alias("fs"), F.lit(True).alias("notch"), F.lit("hr").alias("source"))
    rows = b.design_runs(spark, sf).crossJoin(F.broadcast(recs))  # one row
    manifests.write_run_manifests(rows.select(
        run.alias("run"), train.alias("train"), scaler.alias("scaler"), "fingerprint", "n_train_records", "n_val_records", F.lit(False).alias("reduced_run")
    ), path)
    return manifests.read_run_manifests(spark, path).select(
        "run_id", "block", "fs", "arm", "notch", "source", "seed", "selection", "version", "train.epochs", F.col("scaler.fs").alias("scaler_fs"),
        "fingerprint", "n_train_records", "n_val_records", "reduced_run",
    )


# --- other metrics under the shared resample ---------------------------------------------

_OTHER = with_(
    b.PRED_S, ENSEMBLE, weights_cte("ens"),
    "wens AS (SELECT rep, grp, label, y, score, w FROM ens JOIN weights USING (record_id))",
)


_CUT = Layout((0.2, 0.3, 0.4, 0.5), True)


@query("bootstrap_ci_auprc", _OTHER.rstrip() + ", " + ",\n".join(c.strip() for c in (
    weighted_ap_cte("wens", "rep, grp, label"), ap_cte("ens", "grp, label"),
)) + """,
dm AS (SELECT rep, grp, avg(auprc) AS value FROM wap GROUP BY ALL),
pm AS (SELECT grp, avg(auprc) AS point FROM ap GROUP BY ALL)
SELECT grp, round(max(point), 8) AS point, count(value) AS n_defined,
       round(quantile_cont(value, 0.025::DOUBLE), 8) AS lo, round(quantile_cont(value, 0.975::DOUBLE), 8) AS hi
FROM dm JOIN pm USING (grp) GROUP BY grp""")
def bootstrap_ci_auprc(spark, sf):
    """Forced cuts: totals of the higher score ranges are handed down at every size."""
    ens = ranking.ensemble(b.pred_s(spark, sf))
    out = inference.bootstrap_ci(ens, inference.macro_auprc_metric, ["grp"], N_BOOT, layout=_CUT)
    return out.withColumns({c: rnd(c) for c in ("point", "lo", "hi")})


@query("paired_accuracy", _OTHER + """
, hit AS (SELECT rep, grp, sum(CASE WHEN (score >= 0.5) = (y > 0) THEN w ELSE 0 END)::DOUBLE / sum(w) AS v FROM wens GROUP BY ALL),
pt AS (SELECT grp, avg(((score >= 0.5) = (y > 0))::INT) AS v FROM ens GROUP BY ALL),
pd AS (SELECT x.rep, x.grp AS a, z.grp AS b, x.v - z.v AS v FROM hit x JOIN hit z ON x.rep = z.rep AND x.grp < z.grp)
SELECT a, b, round(max(x.v - z.v), 8) AS diff, round(quantile_cont(pd.v, 0.025::DOUBLE), 8) AS lo, round(quantile_cont(pd.v, 0.975::DOUBLE), 8) AS hi,
       round(least(1.0::DOUBLE, 2.0::DOUBLE * (least(count(*) FILTER (pd.v <= 0), count(*) FILTER (pd.v >= 0)) + 1) / (count(pd.v) + 1)), 8) AS p_value,
       quantile_cont(pd.v, 0.025::DOUBLE) <= 0 AND quantile_cont(pd.v, 0.975::DOUBLE) >= 0 AS crosses_zero
FROM pd JOIN pt x ON x.grp = a JOIN pt z ON z.grp = b GROUP BY a, b""")
def paired_accuracy(spark, sf):
    ens = ranking.ensemble(b.pred_s(spark, sf))
    out = inference.paired_bootstrap(ens, inference.accuracy_metric, N_BOOT, layout=_CUT)
    return out.withColumns({c: rnd(c) for c in ("diff", "lo", "hi", "p_value")})
