"""Queries: bootstrap, intervals, corrections, comparisons and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, inference, ranking
from ..session import scratch_dir
from ..sources import tables
from . import bindings as b
from .registry import ENSEMBLE, N_BOOT, auroc_cte, query, rnd, weighted_auroc_cte, weights_cte, with_

GATE_POINT = 0.8

_RECORDS = "recs AS (SELECT doc_id AS record_id FROM labels)"

_GRP_DRAWS = with_(
    b.PRED_S, b.FROZEN_S, ENSEMBLE, weights_cte("ens"),
    "wens AS (SELECT rep, grp, label, y, score, w FROM ens JOIN weights USING (record_id))",
    weighted_auroc_cte("wens", "rep, grp, label"), auroc_cte("ens", "grp, label"),
    """
pts AS (
  SELECT rep, grp, label, auroc FROM wsc UNION ALL SELECT -1, grp, label, auroc FROM sc),
val AS (
  SELECT rep, grp, 'macro_all' AS endpoint, avg(auroc) AS value, count(auroc) AS n_def FROM pts GROUP BY ALL
  UNION ALL
  SELECT rep, grp, 'macro_clean', avg(auroc) FILTER (label IN (SELECT label FROM frozen_s)),
         count(auroc) FILTER (label IN (SELECT label FROM frozen_s)) FROM pts GROUP BY ALL),
pair AS (
  SELECT x.rep, x.endpoint, x.grp AS a, z.grp AS b, x.value - z.value AS value
  FROM val x JOIN val z ON x.rep = z.rep AND x.endpoint = z.endpoint AND x.grp < z.grp),
raw AS (
  SELECT endpoint, a, b, count(value) AS n_defined, quantile_cont(value, 0.025::DOUBLE) AS lo, quantile_cont(value, 0.975::DOUBLE) AS hi,
         least(1.0::DOUBLE, 2.0::DOUBLE * (least(count(*) FILTER (value <= 0), count(*) FILTER (value >= 0)) + 1) / (count(value) + 1)) AS p_raw,
         quantile_cont(value, (0.05 / 12)::DOUBLE) AS lo_simultaneous, quantile_cont(value, (1 - 0.05 / 12)::DOUBLE) AS hi_simultaneous
  FROM pair WHERE rep >= 0 GROUP BY ALL),
steps AS (
  SELECT *, (count(*) OVER (PARTITION BY endpoint) - row_number() OVER (PARTITION BY endpoint ORDER BY p_raw, a, b) + 1) * p_raw AS s FROM raw),
cmp AS (
  SELECT steps.*, least(1.0::DOUBLE, max(s) OVER (PARTITION BY steps.endpoint ORDER BY p_raw, steps.a, steps.b)) AS p_holm, d.value AS diff
  FROM steps JOIN (SELECT * FROM pair WHERE rep = -1) d ON d.endpoint = steps.endpoint AND d.a = steps.a AND d.b = steps.b)""",
)


@query("bootstrap_weights", with_(_RECORDS, weights_cte("recs")) + "SELECT rep, record_id, w FROM weights")
def bootstrap_weights(spark, sf):
    records = b.table(spark, sf, "labels").select(F.col("doc_id").alias("record_id"))
    return inference.bootstrap_weights(records, N_BOOT)


def _group_draws(spark, sf):
    ens = ranking.ensemble(b.pred_s(spark, sf))
    counts = inference.bootstrap_counts(ens, ["grp"], N_BOOT)
    return inference.macro_draws(counts, ["grp"], b.frozen_s(spark, sf))


@query("percentile_ci", _GRP_DRAWS + """
SELECT endpoint, grp, count(value) AS n_defined, round(quantile_cont(value, 0.025::DOUBLE), 8) AS lo,
       round(quantile_cont(value, 0.975::DOUBLE), 8) AS hi FROM val WHERE rep >= 0 GROUP BY ALL""")
def percentile_ci(spark, sf):
    ci = inference.percentile_ci(_group_draws(spark, sf), ["endpoint", "grp"])
    return ci.withColumns({"lo": rnd("lo"), "hi": rnd("hi")})


@query("paired_diff", _GRP_DRAWS + "SELECT rep, endpoint, a, b, round(value, 8) AS value FROM pair WHERE rep >= 0")
def paired_diff(spark, sf):
    return inference.group_pairs(_group_draws(spark, sf), ["rep", "endpoint"]).withColumn("value", rnd("value"))


@query("bootstrap_p", _GRP_DRAWS + "SELECT endpoint, a, b, n_defined, round(p_raw, 8) AS p_raw FROM raw")
def bootstrap_p(spark, sf):
    diffs = inference.group_pairs(_group_draws(spark, sf), ["rep", "endpoint"])
    return inference.bootstrap_p(diffs, ["endpoint", "a", "b"]).withColumn("p_raw", rnd("p_raw"))


@query("simultaneous_ci", _GRP_DRAWS + """
SELECT endpoint, a, b, round(lo, 8) AS lo, round(hi, 8) AS hi, round(lo_simultaneous, 8) AS lo_simultaneous,
       round(hi_simultaneous, 8) AS hi_simultaneous FROM raw""")
def simultaneous_ci(spark, sf):
    diffs = inference.group_pairs(_group_draws(spark, sf), ["rep", "endpoint"])
    summary = inference.simultaneous(inference.draw_summary(diffs, ["endpoint", "a", "b"]), ["endpoint"])
    cols = ("lo", "hi", "lo_simultaneous", "hi_simultaneous")
    return summary.select("endpoint", "a", "b", *[rnd(c) for c in cols])


_CMP_COLS = ("diff", "lo", "hi", "p_raw", "p_holm", "lo_simultaneous", "hi_simultaneous")
_CMP_SQL = ", ".join(f"round({c}, 8) AS {c}" for c in _CMP_COLS)


@query("compare_groups", _GRP_DRAWS + f"""
SELECT endpoint, a, b, {_CMP_SQL}, n_defined, lo <= 0 AND hi >= 0 AS crosses_zero, p_holm < 0.05 AS significant FROM cmp""")
def compare_groups(spark, sf):
    out = inference.compare_groups(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT)
    return out.withColumns({c: rnd(c) for c in _CMP_COLS})


@query("group_results", _GRP_DRAWS + """
SELECT grp, endpoint, round(max(value) FILTER (rep = -1), 8) AS point,
       round(quantile_cont(value, 0.025::DOUBLE) FILTER (rep >= 0), 8) AS lo,
       round(quantile_cont(value, 0.975::DOUBLE) FILTER (rep >= 0), 8) AS hi,
       count(value) FILTER (rep >= 0) AS n_defined FROM val GROUP BY grp, endpoint""")
def group_results(spark, sf):
    out = inference.group_results(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT)
    return out.withColumns({c: rnd(c) for c in ("point", "lo", "hi")})


_FAMILY_DRAWS = _GRP_DRAWS.replace("ens AS (SELECT grp, record_id", """fam AS (
  SELECT 'rates' AS family, run_id, grp, seed FROM (SELECT DISTINCT run_id, grp, seed FROM pred_s)
  UNION ALL SELECT 'ends', run_id, grp, seed FROM (SELECT DISTINCT run_id, grp, seed FROM pred_s) WHERE grp IN ('100', '500')),
fam_runs AS (SELECT DISTINCT family, grp FROM fam),
ens AS (SELECT grp, record_id""")


@query("analyse_families", _FAMILY_DRAWS + """
, frow AS (
  SELECT f.family, r.endpoint, r.a, r.b, r.n_defined, r.lo, r.hi, r.p_raw, d.value AS diff
  FROM raw r JOIN (SELECT * FROM pair WHERE rep = -1) d USING (endpoint, a, b)
  JOIN fam_runs f ON f.grp = r.a JOIN fam_runs g ON g.family = f.family AND g.grp = r.b),
fstep AS (
  SELECT *, (count(*) OVER (PARTITION BY family, endpoint)
    - row_number() OVER (PARTITION BY family, endpoint ORDER BY p_raw, a, b) + 1) * p_raw AS s FROM frow)
SELECT family, endpoint, a, b, round(diff, 8) AS diff, round(lo, 8) AS lo, round(hi, 8) AS hi, round(p_raw, 8) AS p_raw,
       round(least(1.0::DOUBLE, max(s) OVER (PARTITION BY family, endpoint ORDER BY p_raw, a, b)), 8) AS p_holm,
       n_defined FROM fstep""")
def analyse_families(spark, sf):
    preds = b.pred_s(spark, sf)
    use = F.array(
        F.lit("rates"), F.when(F.col("grp").isin("100", "500"), F.lit("ends"))
    )
    members = preds.withColumn("family", F.explode(F.filter(use, lambda u: u.isNotNull())))
    out = inference.compare_groups(members, b.frozen_s(spark, sf), N_BOOT, family=["family"])
    return out.select(
        "family", "endpoint", "a", "b", *[rnd(c) for c in ("diff", "lo", "hi", "p_raw", "p_holm")], "n_defined"
    )


@query("negative_control", _GRP_DRAWS + """
SELECT endpoint, a, b, round(diff, 8) AS diff, round(p_holm, 8) AS p_holm, a = '240' AND b = '250' AS negative_control FROM cmp""")
def negative_control(spark, sf):
    out = inference.compare_groups(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT)
    return decisions.tag_negative_control(out).select(
        "endpoint", "a", "b", rnd("diff"), rnd("p_holm"), "negative_control"
    )


# --- the metric-function form ------------------------------------------

_METRIC_DRAWS = with_(
    b.PRED_S, ENSEMBLE, weights_cte("ens"),
    "wens AS (SELECT rep, grp, label, y, score, w FROM ens JOIN weights USING (record_id))",
    weighted_auroc_cte("wens", "rep, grp, label"), auroc_cte("ens", "grp, label"),
    "dm AS (SELECT rep, grp, avg(auroc) AS value FROM wsc GROUP BY ALL)",
    "pm AS (SELECT grp, avg(auroc) AS point FROM sc GROUP BY ALL)",
)


@query("bootstrap_ci", _METRIC_DRAWS + """
SELECT grp, round(max(point), 8) AS point, count(value) AS n_defined,
       round(quantile_cont(value, 0.025::DOUBLE), 8) AS lo, round(quantile_cont(value, 0.975::DOUBLE), 8) AS hi
FROM dm JOIN pm USING (grp) GROUP BY grp""")
def bootstrap_ci(spark, sf):
    ens = ranking.ensemble(b.pred_s(spark, sf))
    out = inference.bootstrap_ci(ens, inference.macro_auroc_metric, ["grp"], N_BOOT)
    return out.withColumns({c: rnd(c) for c in ("point", "lo", "hi")})


@query("paired_bootstrap", _METRIC_DRAWS + """
, pd AS (SELECT x.rep, x.grp AS a, z.grp AS b, x.value - z.value AS v FROM dm x JOIN dm z ON x.rep = z.rep AND x.grp < z.grp)
SELECT a, b, round(max(x.point - z.point), 8) AS diff, round(quantile_cont(v, 0.025::DOUBLE), 8) AS lo,
       round(quantile_cont(v, 0.975::DOUBLE), 8) AS hi,
       round(least(1.0::DOUBLE, 2.0::DOUBLE * (least(count(*) FILTER (v <= 0), count(*) FILTER (v >= 0)) + 1) / (count(v) + 1)), 8) AS p_value,
       quantile_cont(v, 0.025::DOUBLE) <= 0 AND quantile_cont(v, 0.975::DOUBLE) >= 0 AS crosses_zero
FROM pd JOIN pm x ON x.grp = a JOIN pm z ON z.grp = b GROUP BY a, b""")
def paired_bootstrap(spark, sf):
    ens = ranking.ensemble(b.pred_s(spark, sf))
    out = inference.paired_bootstrap(ens, inference.macro_auroc_metric, N_BOOT)
    return out.withColumns({c: rnd(c) for c in ("diff", "lo", "hi", "p_value")})


@query("holm_adjust", """
WITH t AS (
  SELECT o_orderkey, o_orderpriority AS family,
         ((('0x' || substr(md5('p:' || o_orderkey), 1, 15))::BIGINT % 100000) + 1) / 100000000.0::DOUBLE AS p_raw FROM orders),
s AS (
  SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_raw, o_orderkey) + 1) * p_raw AS v FROM t)
SELECT o_orderkey, family, round(p_raw, 9) AS p_raw,
       round(least(1.0::DOUBLE, max(v) OVER (PARTITION BY family ORDER BY p_raw, o_orderkey)), 8) AS p_holm FROM s""")
def holm_adjust(spark, sf):
    from ..functions.exprs import hash_draw

    p = (hash_draw(100000, F.lit("p"), "o_orderkey") + 1) / F.lit(100000000.0)
    rows = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("family"), p.alias("p_raw"))
    return inference.holm(rows, ["family"]).select("o_orderkey", "family", rnd("p_raw", 9), rnd("p_holm"))


# --- seed means, null contrasts, verdicts -----------------------------------------------------------

_SEED_MEAN = with_(
    b.PRED_S, b.FROZEN_S, weights_cte("pred_s"),
    "wp AS (SELECT rep, grp, run_id, label, y, score, w FROM pred_s JOIN weights USING (record_id))",
    weighted_auroc_cte("wp", "rep, grp, run_id, label"), auroc_cte("pred_s", "grp, run_id, label"),
    """
rv AS (
  SELECT rep, grp, run_id, 'macro_all' AS endpoint, avg(auroc) AS value FROM wsc GROUP BY ALL
  UNION ALL
  SELECT rep, grp, run_id, 'macro_clean', avg(auroc) FROM wsc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
pv AS (
  SELECT grp, run_id, 'macro_all' AS endpoint, avg(auroc) AS value FROM sc GROUP BY ALL
  UNION ALL
  SELECT grp, run_id, 'macro_clean', avg(auroc) FROM sc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
mv AS (SELECT rep, grp, endpoint, avg(value) AS value FROM rv GROUP BY ALL),
ci AS (
  SELECT grp, endpoint, count(value) AS n_defined, quantile_cont(value, 0.025::DOUBLE) AS lo, quantile_cont(value, 0.975::DOUBLE) AS hi
  FROM mv GROUP BY ALL),
pt AS (
  SELECT grp, endpoint, avg(value) AS point, count(value) AS n_seeds, max(value) - min(value) AS seed_spread,
         coalesce(stddev_samp(value), 0) AS seed_std FROM pv GROUP BY ALL),
sm AS (SELECT * FROM pt JOIN ci USING (grp, endpoint))""",
)


def _seed_mean(spark, sf):
    return inference.seed_mean(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT)


@query("seed_mean_ci", _SEED_MEAN + """
SELECT grp, endpoint, round(point, 8) AS point, n_seeds, round(seed_spread, 8) AS seed_spread, round(seed_std, 8) AS seed_std,
       n_defined, round(lo, 8) AS lo, round(hi, 8) AS hi FROM sm""")
def seed_mean_ci(spark, sf):
    return _seed_mean(spark, sf).withColumns({c: rnd(c) for c in ("point", "seed_spread", "seed_std", "lo", "hi")})


@query("gate_verdict", _SEED_MEAN + f"""
SELECT grp, endpoint, round(point, 8) AS point, round(lo, 8) AS lo, round(hi, 8) AS hi,
       round(point - {GATE_POINT}, 8) AS difference, lo <= {GATE_POINT} AND hi >= {GATE_POINT} AS ci_contains_target,
       abs(point - {GATE_POINT}) <= 0.01 AS point_within_tolerance,
       lo <= {GATE_POINT} AND hi >= {GATE_POINT} AND abs(point - {GATE_POINT}) <= 0.01 AS accepted FROM sm""")
def gate_verdict(spark, sf):
    out = decisions.gate_verdict(_seed_mean(spark, sf), target=GATE_POINT)
    return out.select(
        "grp", "endpoint", rnd("point"), rnd("lo"), rnd("hi"), rnd("difference"),
        "ci_contains_target", "point_within_tolerance", "accepted",
    )


_NULL = """
sub AS (SELECT m FROM range(1, 32) t(m) WHERE bit_count(m::INT) = 2),
sube AS (
  SELECT grp, m AS subset, record_id, label, max(y) AS y, avg(score) AS score
  FROM pred_s JOIN sub ON (m >> seed) & 1 = 1 GROUP BY ALL)"""
_NULL_VALUES = """
nv AS (
  SELECT grp, subset, 'macro_all' AS endpoint, avg(auroc) AS value FROM nsc GROUP BY ALL
  UNION ALL
  SELECT grp, subset, 'macro_clean', avg(auroc) FROM nsc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
nul AS (
  SELECT x.grp, x.endpoint, x.value - z.value AS value FROM nv x JOIN nv z
  ON x.grp = z.grp AND x.endpoint = z.endpoint AND x.subset & z.subset = 0 AND x.subset < z.subset)"""


@query("null_contrast", with_(b.PRED_S, b.FROZEN_S, _NULL, auroc_cte("sube", "grp, subset, label", "nsc"), _NULL_VALUES) + """
SELECT grp, endpoint, count(*) AS n_contrasts, round(median(abs(value)), 8) AS null_median FROM nul GROUP BY ALL
UNION ALL
SELECT 'pooled', endpoint, count(*), round(median(abs(value)), 8) FROM nul GROUP BY endpoint""")
def null_contrast(spark, sf):
    values = decisions.null_contrasts(b.pred_s(spark, sf), b.SEEDS, b.frozen_s(spark, sf))
    # each value counts in its group and in the pool
    both = values.withColumn("grp", F.explode(F.array("grp", F.lit("pooled"))))
    return decisions.null_medians(both, ["grp", "endpoint"]).select("grp", "endpoint", "n_contrasts", rnd("null_median"))


def _delta(spark, sf, pairs):
    preds, frozen = b.pred_s(spark, sf), b.frozen_s(spark, sf)
    pooled = decisions.null_medians(decisions.null_contrasts(preds, b.SEEDS, frozen), ["endpoint"])
    scored = ranking.auroc(preds, ["grp", "run_id", "label"])
    per_run = inference.endpoint_values(scored, ["grp", "run_id"], frozen)
    dispersion = per_run.groupBy("grp", "endpoint").agg(
        (F.max("value") - F.min("value")).alias("seed_spread"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("seed_std"), F.count("value").alias("n_seeds"),
    )
    return decisions.interpret_delta(pairs, pooled, dispersion)


@query("interpret_delta", _GRP_DRAWS + ", " + ",\n".join(
    c.strip() for c in (
        _NULL, auroc_cte("sube", "grp, subset, label", "nsc"), _NULL_VALUES,
        auroc_cte("pred_s", "grp, run_id, label", "rsc"), """
rv AS (
  SELECT grp, run_id, 'macro_all' AS endpoint, avg(auroc) AS value FROM rsc GROUP BY ALL
  UNION ALL
  SELECT grp, run_id, 'macro_clean', avg(auroc) FROM rsc WHERE label IN (SELECT label FROM frozen_s) GROUP BY ALL),
sp AS (
  SELECT endpoint, max(spread) AS max_seed_spread, max(std) AS max_seed_std FROM (
    SELECT grp, endpoint, max(value) - min(value) AS spread, coalesce(stddev_samp(value), 0) AS std FROM rv GROUP BY ALL) GROUP BY ALL),
pool AS (SELECT endpoint, median(abs(value)) AS c FROM nul GROUP BY ALL),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY abs(diff) DESC, a, b) AS rn FROM cmp) WHERE rn = 1)""")
) + """
SELECT endpoint, a, b, round(diff, 8) AS delta, round(lo, 8) AS lo, round(hi, 8) AS hi, round(p_holm, 8) AS p_holm,
       lo <= 0 AND hi >= 0 AS crosses_zero, 'null_contrast' AS comparator, round(c, 8) AS comparator_value,
       round(c * sqrt(0.4::DOUBLE), 8) AS null_contrast_matched,
       round(max_seed_spread, 8) AS max_seed_spread, round(max_seed_std, 8) AS max_seed_std,
       CASE WHEN (lo <= 0 AND hi >= 0) OR abs(diff) <= c THEN 'not_detectable'
            WHEN abs(diff) < 0.006 THEN 'below_typical_gap'
            WHEN abs(diff) < 0.019 THEN 'comparable_to_reported_gaps' ELSE 'exceeds_any_gap' END AS verdict
FROM top JOIN pool USING (endpoint) JOIN sp USING (endpoint)""")
def interpret_delta(spark, sf):
    out = _delta(spark, sf, inference.compare_groups(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT))
    return out.select(
        "endpoint", "a", "b", rnd("delta"), rnd("lo"), rnd("hi"), rnd("p_holm"), "crosses_zero", "comparator",
        rnd("comparator_value"), rnd("null_contrast_matched"), rnd("max_seed_spread"), rnd("max_seed_std"), "verdict",
    )


@query("write_reports", _GRP_DRAWS + f"""
, best AS (SELECT endpoint, a AS top_a, b AS top_b FROM (
    SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY abs(diff) DESC, a, b) AS rn FROM cmp) WHERE rn = 1)
SELECT 'rates' AS analysis, endpoint, a, b, {', '.join(f'round({c}, 6) AS {c}' for c in _CMP_COLS)},
       a = '240' AND b = '250' AS negative_control, (SELECT count(DISTINCT grp) FROM ens) AS report_groups,
       a = top_a AND b = top_b AS reported_top
FROM cmp JOIN best USING (endpoint)""")
def write_reports(spark, sf):
    """One bootstrap for both files; the flags come back out of the nested one."""
    draws = inference.group_draws(b.pred_s(spark, sf), b.frozen_s(spark, sf), N_BOOT)
    pairs = inference.compare_draws(draws)
    rows = pairs.select(
        F.lit("rates").alias("analysis"), "endpoint", "a", "b", *[F.format_string("%.6f", F.col(c)).alias(c) for c in _CMP_COLS]
    )
    path = scratch_dir(spark, "report")
    tables.write_csv(rows, f"{path}/pairs")
    control = decisions.tag_negative_control(pairs)
    tables.write_nested_report(control, inference.describe_draws(draws), _delta(spark, sf, pairs), f"{path}/report")
    schema = "analysis string, endpoint string, a string, b string, " + ", ".join(f"{c} double" for c in _CMP_COLS)
    back = spark.read.schema(schema).option("header", True).csv(f"{path}/pairs")
    nested = spark.read.schema(
        "endpoint string, groups array<struct<grp: string, point: double>>, pairs array<struct<a: string, b: string, negative_control: boolean>>, "
        "delta struct<a: string, b: string, verdict: string>"
    ).json(f"{path}/report")
    flags = nested.select("endpoint", F.size("groups").cast("long").alias("report_groups"), "delta", F.inline("pairs")).select(
        "endpoint", "a", "b", "negative_control", "report_groups", ((F.col("delta.a") == F.col("a")) & (F.col("delta.b") == F.col("b"))).alias("reported_top")
    )
    return back.withColumns({c: rnd(c, 6) for c in _CMP_COLS}).join(flags, ["endpoint", "a", "b"])
