"""Queries: run matrix, families, histories, selection, fingerprints, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import is_finite, set_fingerprint
from ..operators import experiments
from ..session import scratch_dir
from ..sources import tables
from . import bindings as b
from .registry import query, rnd, with_

_CONFIG = "fs, arm, notch, source, seed"


@query("load_runs", with_(b.RUNS) + "SELECT run_id, block, fs, arm, notch, source, seed, selection FROM runs")
def load_runs(spark, sf):
    path = scratch_dir(spark, "runs")
    rows = b.run_matrix(spark, sf).withColumn("notch", F.col("notch").cast("int"))
    tables.write_csv(rows.select(*tables.RUN_COLUMNS), path)
    return tables.load_runs(spark, path)


@query("duplicate_configs", with_(b.RUNS) + f"""
SELECT {_CONFIG}, n_runs, run_id
FROM (SELECT *, count(*) OVER (PARTITION BY {_CONFIG}) AS n_runs FROM runs) WHERE n_runs > 1""")
def duplicate_configs(spark, sf):
    return experiments.duplicate_configs(b.run_matrix(spark, sf))


@query("replicate_pairs", with_(b.RUNS) + f"""
SELECT {_CONFIG}, x.block AS block_a, x.run_id AS run_a, z.block AS block_b, z.run_id AS run_b
FROM runs x JOIN runs z USING (fs, arm, notch, source, seed) WHERE x.block < z.block""")
def replicate_pairs(spark, sf):
    return experiments.replicate_pairs(b.run_matrix(spark, sf))


_FAMILIES = """
fam AS (
  SELECT 'rates' AS analysis, 'rates' AS family, fs::VARCHAR AS grp, run_id, seed, run_key FROM runs WHERE block = 1
  UNION ALL SELECT 'arms', 'arms@' || fs, arm, run_id, seed, run_key FROM runs WHERE block IN (1, 2) AND fs IN (240, 250, 500)
  UNION ALL SELECT 'notch', 'notch@100', CASE WHEN block = 1 THEN 'with' ELSE 'without' END, run_id, seed, run_key
            FROM runs WHERE (block = 1 AND fs = 100) OR block = 3
  UNION ALL SELECT 'source', 'source@100', CASE WHEN block = 3 THEN 'resampled' ELSE 'distributed' END, run_id, seed, run_key
            FROM runs WHERE block IN (3, 4))"""


@query("family_grouping", with_(b.RUNS, _FAMILIES) + "SELECT analysis, family, grp, run_id, seed FROM fam")
def family_grouping(spark, sf):
    return experiments.families(b.run_matrix(spark, sf))


@query("family_completeness", with_(b.RUNS, _FAMILIES) + """
SELECT analysis, family, count(*) AS n_declared, count(*) FILTER (run_key % 7 = 0) AS n_missing,
       count(*) FILTER (run_key % 7 = 0) = 0 AS complete FROM fam GROUP BY analysis, family""")
def family_completeness(spark, sf):
    runs = b.run_matrix(spark, sf)
    return experiments.family_completeness(experiments.families(runs), runs.where(F.col("run_key") % 7 != 0))


@query("source_guards", """
SELECT event_id, fs, notch, source, CASE
  WHEN fs NOT IN (100, 240, 250, 500) THEN 'rate_not_in_protocol'
  WHEN source NOT IN ('hr', 'lr') THEN 'unknown_source'
  WHEN source = 'lr' AND fs <> 100 THEN 'distributed_source_at_other_rate'
  WHEN source = 'lr' AND notch THEN 'distributed_source_with_notch' ELSE 'ok' END AS status
FROM (SELECT event_id, [100, 240, 250, 360, 500][user_id % 5 + 1] AS fs, event_type = 'click' AS notch,
             CASE WHEN event_id % 3 = 0 THEN 'lr' WHEN event_id % 31 = 1 THEN 'xr' ELSE 'hr' END AS source FROM events)""")
def source_guards(spark, sf):
    rates = F.array(*[F.lit(v) for v in (100, 240, 250, 360, 500)])
    i = F.col("event_id")
    requests = b.table(spark, sf, "events").select(
        "event_id", F.element_at(rates, (F.col("user_id") % 5 + 1).cast("int")).alias("fs"),
        (F.col("event_type") == "click").alias("notch"),
        F.when(i % 3 == 0, "lr").when(i % 31 == 1, "xr").otherwise("hr").alias("source"),
    )
    return experiments.source_guards(requests, (100, 240, 250, 500))


@query("finite_filter", """
SELECT event_id, value FROM events WHERE event_id % 10 NOT IN (3, 6, 9)""")
def finite_filter(spark, sf):
    i = F.col("event_id") % 10
    rows = b.table(spark, sf, "events").select(
        "event_id",
        F.when(i == 3, F.lit(float("nan"))).when(i == 6, F.lit(float("inf"))).when(i != 9, F.col("value")).alias("value"),
    )
    return rows.where(is_finite("value"))


# --- histories ---------------------------------------------------------------------------------

@query("scan_history", with_(b.HIST) + "SELECT run_id, epoch, train_loss, macro_all, macro_clean FROM hist")
def scan_history(spark, sf):
    path = scratch_dir(spark, "history")
    tables.write_history(b.history(spark, sf), path)
    return tables.scan_history(spark, path).select("run_id", "epoch", "train_loss", "macro_all", "macro_clean")


_BEST = """
best AS (
  SELECT run_id, max(epoch) FILTER (ra = 1) AS best_macro_all, max(epoch) FILTER (rc = 1) AS best_macro_clean FROM (
    SELECT run_id, epoch,
           row_number() OVER (PARTITION BY run_id ORDER BY macro_all DESC NULLS LAST, epoch) AS ra,
           row_number() OVER (PARTITION BY run_id ORDER BY macro_clean DESC NULLS LAST, epoch) AS rc FROM hist) GROUP BY run_id),
sel AS (
  SELECT *, CASE WHEN run_id IN ('r0', 'r1', 'r2', 'r3') THEN 'macro_all' ELSE 'macro_clean' END AS selection FROM best),
picked AS (
  SELECT s.*, h.epoch AS selected_epoch, best_macro_all = best_macro_clean AS criteria_agree, macro_all, macro_clean
  FROM sel s JOIN hist h ON h.run_id = s.run_id
   AND h.epoch = CASE WHEN selection = 'macro_all' THEN best_macro_all ELSE best_macro_clean END)"""


def _selection(spark, sf):
    chosen = F.when(F.col("run_id") < "r4", F.lit("macro_all")).otherwise(F.lit("macro_clean"))
    return experiments.epoch_selection(b.history(spark, sf), chosen)


@query("best_epoch", with_(b.HIST, _BEST) + "SELECT run_id, best_macro_all, best_macro_clean FROM best")
def best_epoch(spark, sf):
    return experiments.best_epochs(b.history(spark, sf))


@query("epoch_selection", with_(b.HIST, _BEST) + """
SELECT run_id, selection, selected_epoch, best_macro_all, best_macro_clean, criteria_agree, macro_all, macro_clean FROM picked""")
def epoch_selection(spark, sf):
    return _selection(spark, sf)


@query("scan_manifests", with_(b.HIST, _BEST) + """
SELECT run_id, selection, selected_epoch, best_macro_all, best_macro_clean, criteria_agree, macro_all, macro_clean FROM picked""")
def scan_manifests(spark, sf):
    path = scratch_dir(spark, "selection")
    tables.write_json(_selection(spark, sf).select(
        "run_id", "selection", "selected_epoch",
        F.struct(F.col("best_macro_all").alias("macro_all"), F.col("best_macro_clean").alias("macro_clean")).alias("best_epoch_per_metric"),
        "criteria_agree", F.struct("macro_all", "macro_clean").alias("value_at_selected_epoch"),
    ).repartition("run_id"), path)
    # one JSON object per line here; the reader also takes one object per file
    return spark.read.schema(tables.SELECTION_SCHEMA).json(path).select(
        "run_id", "selection", "selected_epoch", F.col("best_epoch_per_metric.macro_all").alias("best_macro_all"),
        F.col("best_epoch_per_metric.macro_clean").alias("best_macro_clean"), "criteria_agree",
        "value_at_selected_epoch.macro_all", "value_at_selected_epoch.macro_clean",
    )


@query("replicate_drift", with_(b.HIST) + """
SELECT x.run_id AS run_a, z.run_id AS run_b, count(*) AS n_epochs,
       round(max(abs(x.train_loss - z.train_loss)), 6) AS max_train_loss, round(max(abs(x.macro_all - z.macro_all)), 6) AS max_macro_all,
       round(max(abs(x.macro_clean - z.macro_clean)), 6) AS max_macro_clean,
       count(*) FILTER (x.train_loss = z.train_loss) AS exact_train_loss, count(*) FILTER (x.macro_all = z.macro_all) AS exact_macro_all,
       count(*) FILTER (x.macro_clean = z.macro_clean) AS exact_macro_clean
FROM hist x JOIN hist z ON x.config = z.config AND x.epoch = z.epoch AND x.block < z.block GROUP BY ALL""")
def replicate_drift(spark, sf):
    h = b.history(spark, sf)
    pairs = experiments.replicate_pairs(h.select("run_id", "config", "block").distinct(), ["config"])
    out = experiments.replicate_drift(h, pairs)
    return out.withColumns({c: rnd(c, 6) for c in ("max_train_loss", "max_macro_all", "max_macro_clean")})


# --- provenance ------------------------------------------------------------------------------------

def _fp_sql(key: str) -> str:
    d = f"md5({key})"
    h1 = f"('0x' || substr({d}, 1, 15))::BIGINT"
    h2 = f"('0x' || substr({d}, 16, 15))::BIGINT"
    return (
        f"substr(sha256(count(*) || ':' || bit_xor({h1}) || ':' || bit_xor({h2}) || ':' || sum({h1})), 1, 16)"
    )


@query("record_fingerprint", with_(b.ORDER_RECORDS) + f"""
SELECT {b.SPLIT_SQL} AS split, {_fp_sql("record_id::VARCHAR")} AS fingerprint, count(*) AS n_records FROM order_records GROUP BY 1""")
def record_fingerprint(spark, sf):
    from ..operators.records import assign_splits

    return experiments.record_fingerprint(assign_splits(b.order_records(spark, sf)), by=["split"])


@query("config_fingerprint", with_(b.RUNS, b.ORDER_RECORDS, f"""
ids AS (SELECT {_fp_sql("record_id::VARCHAR")} AS d FROM order_records WHERE fold <= 8)""") + """
SELECT run_id, substr(sha256('{"arm":"' || arm || '","batch_size":64,"block":' || block || ',"fs":' || fs || ',"notch":' || notch
  || ',"run_id":"' || run_id || '","seed":' || seed || ',"selection":"' || selection || '","source":"' || source
  || '","train_record_ids":"' || d || '"}'), 1, 16) AS fingerprint FROM runs, ids""")
def config_fingerprint(spark, sf):
    train = b.order_records(spark, sf).where(F.col("fold") <= 8)
    digest = train.agg(set_fingerprint("record_id").alias("train_record_ids"))
    runs = b.run_matrix(spark, sf).join(F.broadcast(digest)).withColumn("batch_size", F.lit(64))  # one row
    # the epoch and worker counts stay out: changing them must not invalidate a run
    parts = [*tables.RUN_COLUMNS, "batch_size", "train_record_ids"]
    return experiments.config_fingerprint(runs, parts).select("run_id", "fingerprint")
