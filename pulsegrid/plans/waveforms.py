"""Queries: signals, windows, scaling, filters and spectra.

The supplied arrays have 64 samples.  Windows read them at a nominal 40 Hz (1.6 s,
windows of 0.4 s); spectra at 64 Hz, so bins are whole hertz.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import epoch_seed, grid_status, set_fingerprint
from ..operators import signals as S
from ..session import scratch_dir
from ..sources import manifests, signals as store, tables
from . import bindings as b
from .registry import query, rnd, with_
from .runs import _fp_sql

FS, RECORD_DS, WINDOW_DS = 40, 16, 4
N = 64
LOW_FS = 20
PSD_RATES = (16, 32, 48, 64)
BANDS = ((4.0, 6.0), (9.0, 11.0), (14.0, 16.0), (19.0, 21.0))
CONTROLS = ((24.0, 27.0), (28.0, 31.0))


def _values(df, *keys, digits=6):
    return df.select(*keys, F.posexplode("samples").alias("m", "value")).withColumn("value", F.round("value", digits))


def _lead_number():
    """A lead's number in the table, which its name carries through the files."""
    return F.substring("lead_name", 2, 9).cast("int")


def fir_cte(src: str, n_in: int, up: int, down: int, keys: str, name: str = "fir") -> str:
    taps = kernels.resample_taps(up, down)
    half = len(taps) // 2
    rows = ", ".join(f"({k - half}, {float(h)!r}::DOUBLE)" for k, h in enumerate(taps))
    return f"""
{name}_taps AS (SELECT * FROM (VALUES {rows}) t(k, h)),
{name}_x AS (SELECT {keys}, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) - 1 AS n FROM {src}),
{name} AS (
  SELECT {keys}, m::INT AS m, sum(x * h) AS value FROM {name}_x, range({-(-n_in * up // down)}) r(m)
  JOIN {name}_taps ON k = m * {down} - n * {up} GROUP BY ALL)"""


# --- ingest and store ---------------------------------------------------------------------------

@query("ingest_signals", with_(b.SIG) + """
SELECT lpad(record_id::VARCHAR, 5, '0') AS stem, lead, 40 AS fs, m::INT AS m, round(round(x * 1000) / 1000, 6) AS value
FROM (SELECT record_id, lead, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) - 1 AS m FROM sig)""")
def ingest_signals(spark, sf):
    """Every record is held to its own leads in the table; the last one may have fewer than four."""
    sig = b.sig(spark, sf, FS)
    held = store.encode_signals(sig, path="raw")
    leads = sig.groupBy(F.format_string("raw/%05d", "record_id").alias("stem")).agg(F.count_distinct("lead").alias("n_leads"))
    got = store.ingest_signals(held, n_leads=leads, n_samples=N)
    return _values(got.withColumns({"stem": F.regexp_replace("stem", "^raw/", ""), "lead": _lead_number()}), "stem", "lead", "fs")


@query("read_signal_files", with_(b.SIG) + """
SELECT record_id, source, lead, 'L' || lead AS lead_name, fs, m::INT AS m, round(round(x * 1000) / 1000, 6) AS value FROM (
  SELECT record_id, 'hr' AS source, lead, 40 AS fs, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) - 1 AS m FROM sig
  UNION ALL
  SELECT record_id, 'lr', lead, 20, unnest(samples[1:64:2])::DOUBLE AS x, generate_subscripts(samples[1:64:2], 1) - 1 FROM sig)""")
def read_signal_files(spark, sf):
    """Both sources of every record, each found by the path column of the record table."""
    root = scratch_dir(spark, "files")
    sig = b.sig(spark, sf, FS)
    path = lambda kind: F.concat(F.lit(f"records{kind}/"), F.format_string("%05d_", "record_id"), F.lit(kind))
    half = F.filter("samples", lambda x, i: i % 2 == 0)
    store.write_signal_files(sig.withColumn("name", path("hr")), root)
    store.write_signal_files(sig.withColumns({"name": path("lr"), "samples": half, "fs": F.lit(LOW_FS)}), root)
    records = sig.groupBy("record_id").agg(F.count_distinct("lead").alias("n_leads")).withColumns({"filename_hr": path("hr"), "filename_lr": path("lr")})
    got = [store.read_signal_files(records, root, s, leads="n_leads", n_samples=n) for s, n in (("hr", N), ("lr", N // 2))]
    return _values(got[0].unionByName(got[1]).withColumn("lead", _lead_number()), "record_id", "source", "lead", "lead_name", "fs")


def _stored(spark, sf):
    root = scratch_dir(spark, "store")
    sig = b.sig(spark, sf, FS)
    ids = sig.select("record_id").distinct()
    for fs in (FS, LOW_FS):
        rows = S.preprocess(sig, fs, notch=False, source_fs=FS, rates=(LOW_FS, FS)).drop("fs", "notch", "source")
        store.write_signals(rows, root, source="hr", fs=fs, notch=False, n_samples=N * fs // FS, records=ids)
    return root, ids


@query("signal_store_write", with_(b.SIG) + """
SELECT 'hr' AS source, unnest([40, 20]) AS fs, false AS notch, count(*) AS n_rows, unnest([64, 32]) AS n_samples FROM sig""")
def signal_store_write(spark, sf):
    root, _ = _stored(spark, sf)
    got = store.read_signals(spark, root, rates=[FS, LOW_FS], notch=False)
    return got.groupBy("source", "fs", "notch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("samples")).alias("n_samples")
    )


@query("signal_store_read", with_(b.SIG, fir_cte("sig", N, 1, 2, "record_id, lead")) + """
SELECT record_id, lead, m, round(value::FLOAT::DOUBLE, 6) AS value FROM fir""")
def signal_store_read(spark, sf):
    root, ids = _stored(spark, sf)
    got = store.read_signals(spark, root, rates=[LOW_FS], notch=False, records=ids)
    return _values(got.withColumn("samples", F.col("samples").cast("array<double>")), "record_id", "lead")


@query("store_environment", """
SELECT 'hr_fs' || fs || '_notch0' AS store, 4::BIGINT AS n_packages, CASE WHEN fs = 20 THEN 1 ELSE 0 END::BIGINT AS n_changed,
       CASE WHEN fs = 20 THEN DATE '2020-01-02' END AS built_on FROM (SELECT unnest([20, 40]) AS fs)""")
def store_environment(spark, sf):
    """One of the two sidecars is replaced by that of an older build."""
    root, _ = _stored(spark, sf)
    older = manifests.current_environment(spark) | {"numpy": "1.0.0"}
    spark.createDataFrame([older]).withColumn("built_at", F.lit("2020-01-02 03:04:05").cast("timestamp")).coalesce(1).write.mode("overwrite").json(
        f"{root}/environment/hr_fs{LOW_FS}_notch0"
    )
    report = manifests.environment_report(spark, root)
    return report.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_packages"), F.count_if(~F.col("same")).alias("n_changed"),
        F.min(F.when(F.col("built_on") < F.current_date(), F.col("built_on"))).alias("built_on"),
    )


@query("store_recompute", with_(b.SIG) + "SELECT count(*) AS n_rows, 0::BIGINT AS n_incomparable, 0.0::DOUBLE AS max_abs_diff FROM sig")
def store_recompute(spark, sf):
    root, ids = _stored(spark, sf)
    stored = store.read_signals(spark, root, rates=[LOW_FS], notch=False, records=ids)
    fresh = S.preprocess(b.sig(spark, sf, FS), LOW_FS, notch=False, source_fs=FS, rates=(LOW_FS, FS))
    return S.compare_stored(stored, fresh)


# --- time grid and windows --------------------------------------------------------------------------

@query("grid_index", """
SELECT event_id, fs, CASE WHEN ms % 100 <> 0 THEN 'off_grid' WHEN ms * fs % 1000 <> 0 THEN 'off_sample' ELSE 'ok' END AS status,
       CASE WHEN ms % 100 = 0 AND ms * fs % 1000 = 0 THEN ms * fs // 1000 END AS idx
FROM (SELECT event_id, event_id * 50 % 7600 AS ms, [100, 240, 250, 500, 125][user_id % 5 + 1] AS fs FROM events)""")
def grid_index(spark, sf):
    from ..functions.exprs import decisecond_index

    rates = F.array(*[F.lit(v) for v in (100, 240, 250, 500, 125)])
    rows = b.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") * 50 % 7600).alias("ms"),
        F.element_at(rates, (F.col("user_id") % 5 + 1).cast("int")).alias("fs"),
    )
    status = grid_status("ms", "fs")
    return rows.select(
        "event_id", "fs", status.alias("status"), F.when(status == "ok", decisecond_index("ms", "fs")).alias("idx")
    )


_WINDOW_COLS = """record_id, lead, start_ds, len(w)::INT AS n, round(w[1]::DOUBLE, 6) AS first_value,
       round(list_sum(w::DOUBLE[]), 6) AS window_sum"""


def _window_rows(df):
    return df.select(
        "record_id", "lead", "start_ds", F.size("samples").alias("n"),
        F.round(F.col("samples")[0].cast("double"), 6).alias("first_value"),
        F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("window_sum"),
    )


@query("crop_windows", with_(b.SIG) + f"""
SELECT {_WINDOW_COLS} FROM (SELECT record_id, lead, start_ds::INT AS start_ds, samples[start_ds * 4 + 1 : start_ds * 4 + 16] AS w
  FROM (SELECT *, (record_id * 7 + lead) % 13 AS start_ds FROM sig))""")
def crop_windows(spark, sf):
    start = ((F.col("record_id") * 7 + F.col("lead")) % 13).cast("int")
    return _window_rows(S.crop(b.sig(spark, sf, FS).withColumn("start_ds", start), WINDOW_DS))


@query("inference_windows", with_(b.SIG) + f"""
SELECT {_WINDOW_COLS} FROM (SELECT record_id, lead, start_ds, samples[start_ds * 4 + 1 : start_ds * 4 + 16] AS w
  FROM (SELECT *, unnest([0, 4, 8, 12]) AS start_ds FROM sig))""")
def inference_windows(spark, sf):
    return _window_rows(S.inference_windows(b.sig(spark, sf, FS), RECORD_DS, WINDOW_DS))


_SEEDED = """
seeded AS (
  SELECT *, (('0x' || substr(md5('7:3:' || record_id), 1, 15))::BIGINT % 13)::INT AS start_ds FROM sig)"""


@query("seeded_crop", with_(b.SIG, _SEEDED) + f"""
SELECT {_WINDOW_COLS} FROM (SELECT record_id, lead, start_ds, samples[start_ds * 4 + 1 : start_ds * 4 + 16] AS w FROM seeded)""")
def seeded_crop(spark, sf):
    return _window_rows(S.seeded_crop(b.sig(spark, sf, FS), 7, 3, RECORD_DS, WINDOW_DS))


@query("epoch_seed", """
SELECT event_id, ('0x' || substr(md5(user_id || ':' || event_id % 100), 1, 15))::BIGINT % 2147483646 + 1 AS seed FROM events""")
def epoch_seeds(spark, sf):
    return b.table(spark, sf, "events").select("event_id", epoch_seed("user_id", F.col("event_id") % 100).alias("seed"))


# --- scaler -------------------------------------------------------------------------------------------

_SCALER = f"""
scaler AS (
  SELECT avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n_values FROM (SELECT unnest(samples)::DOUBLE AS v FROM sig WHERE fold <= 8)),
used AS (SELECT {_fp_sql("record_id || ':' || lead")} AS record_fingerprint FROM sig WHERE fold <= 8)"""


@query("global_scaler", with_(b.SIG, _SCALER) + """
SELECT 40 AS fs, false AS notch, 'hr' AS source, 'full_record' AS "window", '1-8' AS folds, round(mean, 9) AS mean, round(std, 9) AS std,
       n_values, record_fingerprint FROM scaler, used""")
def global_scaler(spark, sf):
    path = scratch_dir(spark, "scaler")
    tables.write_json(S.fit_scaler(b.sig(spark, sf, FS)), path)
    return tables.read_scalers(spark, path).select(
        "fs", "notch", "source", "window", "folds", rnd("mean", 9), rnd("std", 9), "n_values", "record_fingerprint"
    )


@query("standardise", with_(b.SIG, _SCALER) + """
SELECT record_id, lead, round(list_sum([((x::DOUBLE - mean) / std)::FLOAT::DOUBLE FOR x IN samples]), 4) AS total, len(samples)::INT AS n
FROM sig, scaler""")
def standardise(spark, sf):
    sig = b.sig(spark, sf, FS)
    scaled = S.standardise(sig, S.fit_scaler(sig))
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    # samples are single precision, so the sum is compared to four digits
    return scaled.select("record_id", "lead", F.round(total, 4).alias("total"), F.size("samples").alias("n"))


@query("scaler_resolve", with_(b.RUNS) + """
SELECT run_id, CASE WHEN block = 0 THEN fs ELSE 500 END AS fit_fs, CASE WHEN block = 0 THEN notch ELSE true END AS fit_notch,
       CASE WHEN block = 0 THEN 'wrong_provenance' ELSE 'reuse' END AS status FROM runs""")
def scaler_resolve(spark, sf):
    sig = b.sig(spark, sf, FS)
    base = S.fit_scaler(sig).drop("fs", "notch")
    # two stored scalers; the second was fitted on other folds than it should be
    stored = base.withColumns({"fs": F.lit(500), "notch": F.lit(True)}).unionByName(
        base.withColumns({"fs": F.lit(100), "notch": F.lit(False), "folds": F.lit("1-9")})
    )
    train = sig.where(F.col("fold") <= 8).agg(set_fingerprint("record_id", "lead").alias("fingerprint"))
    want = train.select("fingerprint", F.inline(F.array(
        F.struct(F.lit(500).alias("fs"), F.lit(True).alias("notch")), F.struct(F.lit(100).alias("fs"), F.lit(False).alias("notch"))
    )))
    return S.resolve_scaler(b.run_matrix(spark, sf), stored, want).select("run_id", "fit_fs", "fit_notch", "status")


@query("training_view", with_(b.SIG, _SCALER, _SEEDED) + """
SELECT record_id, lead, start_ds, len(w)::INT AS n, round((w[1]::DOUBLE - mean) / std, 4) AS first_value,
       (record_id % 2)::INT::VARCHAR || ',' || (record_id % 3 = 0)::INT AS target
FROM (SELECT record_id, lead, start_ds, samples[start_ds * 4 + 1 : start_ds * 4 + 16] AS w FROM seeded), scaler""")
def training_view(spark, sf):
    sig = b.sig(spark, sf, FS)
    labels = sig.select("record_id").distinct().select("record_id", F.inline(F.array(
        F.struct(F.lit("a").alias("label"), (F.col("record_id") % 2).cast("int").alias("y")),
        F.struct(F.lit("b").alias("label"), (F.col("record_id") % 3 == 0).cast("int").alias("y")),
    )))
    view = S.training_view(sig, labels, S.fit_scaler(sig), 7, 3, RECORD_DS, WINDOW_DS)
    return view.select(
        "record_id", "lead", "start_ds", F.size("samples").alias("n"),
        F.round(F.col("samples")[0].cast("double"), 4).alias("first_value"), F.array_join("target", ",").alias("target"),
    )


# --- filters --------------------------------------------------------------------------------------------

@query("fir_resample", with_(b.SIG, fir_cte("sig", N, 1, 2, "record_id, lead")) + """
SELECT record_id, lead, m, round(value, 6) AS value FROM fir""")
def fir_resample(spark, sf):
    return _values(S.resample(b.sig(spark, sf, FS), LOW_FS, source_fs=FS, rates=(LOW_FS, FS)), "record_id", "lead")


@query("fir_resample_12_25", with_(b.SIG, fir_cte("sig", N, 12, 25, "record_id, lead")) + """
SELECT record_id, lead, m, round(value, 6) AS value FROM fir""")
def fir_resample_12_25(spark, sf):
    return _values(S.resample(b.sig(spark, sf, FS), 240, source_fs=500), "record_id", "lead")


def _notch_cte() -> str:
    """The notch as two plain recurrences over an odd extension of nine samples."""
    b_, a_ = kernels.notch_coefficients(50.0, 30.0, 500.0)
    (b0, b1, b2), (_, a1, a2) = ((f"({float(v)!r})::DOUBLE" for v in c) for c in (b_, a_))

    def sweep(name: str, src: str) -> str:
        return f"""
{name} AS (
  SELECT id, t, {b0} * x + zz1 AS y, {b1} * x - {a1} * ({b0} * x + zz1) + zz2 AS z1, {b2} * x - {a2} * ({b0} * x + zz1) AS z2
  FROM (SELECT *, ({b1} - {a1}) * x + ({b2} - {a2}) * x AS zz1, ({b2} - {a2}) * x AS zz2 FROM {src} WHERE t = 0)
  UNION ALL
  SELECT p.id, e.t, {b0} * e.x + p.z1, {b1} * e.x - {a1} * ({b0} * e.x + p.z1) + p.z2, {b2} * e.x - {a2} * ({b0} * e.x + p.z1)
  FROM {name} p JOIN {src} e ON e.id = p.id AND e.t = p.t + 1)"""

    return f"""
sid AS (SELECT *, len(s) AS n, len(s) + 17 AS last, row_number() OVER (ORDER BY record_id, lead) AS id FROM sig_t),
ext AS (
  SELECT id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS t FROM (
    SELECT id, list_concat(list_concat([2 * s[1] - s[i + 1] FOR i IN [9, 8, 7, 6, 5, 4, 3, 2, 1]], s),
                           [2 * s[n] - s[n - i] FOR i IN [1, 2, 3, 4, 5, 6, 7, 8, 9]]) AS e FROM sid)),
{sweep("fwd", "ext").strip()},
rev AS (SELECT id, last - t AS t, y AS x FROM fwd JOIN sid USING (id)),
{sweep("bwd", "rev").strip()},
notched AS (SELECT record_id, lead, last - t - 9 AS m, y AS value FROM bwd JOIN sid USING (id) WHERE last - t BETWEEN 9 AND last - 9)"""


_SUMMARY = """
SELECT record_id, lead, count(*)::INT AS n, round(sum(value), 3) AS total, round(sum(value * (m + 1)), 1) AS moment,
       round(sqrt(sum(value * value)), 4) AS norm FROM"""


def _summary(df):
    """Per signal: plain, position-weighted and squared sums."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    x = F.transform("samples", lambda v: v.cast("double"))
    weighted = F.transform("samples", lambda v, i: v.cast("double") * (i + 1))
    squared = F.transform("samples", lambda v: v.cast("double") * v.cast("double"))
    return df.select(
        "record_id", "lead", F.size("samples").alias("n"), F.round(total(x), 3).alias("total"),
        F.round(total(weighted), 1).alias("moment"), F.round(F.sqrt(total(squared)), 4).alias("norm"),
    )


def _resampled_cte() -> str:
    up, down = kernels.rate_factors(500, 240)
    taps = kernels.resample_taps(up, down)
    half = len(taps) // 2
    rows = ", ".join(f"({k - half}, {float(h)!r}::DOUBLE)" for k, h in enumerate(taps))
    return f"""
taps AS (SELECT * FROM (VALUES {rows}) t(k, h)),
uses AS (SELECT r.m, (r.m * {down} - k) // {up} AS n, h FROM (SELECT unnest(range((hours * {up} + {down - 1}) // {down})) AS m FROM span) r, taps WHERE (r.m * {down} - k) % {up} = 0),
low AS (
  SELECT record_id, lead, u.m, sum(value * h)::FLOAT::DOUBLE AS value FROM notched x JOIN uses u ON u.n = x.m GROUP BY record_id, lead, u.m)"""


@query("notch_filter", "WITH RECURSIVE " + with_(b.SIG_T, _notch_cte())[5:] + _SUMMARY + " notched GROUP BY record_id, lead")
def notch_filter(spark, sf):
    return _summary(S.notch_filter(b.sig_t(spark, sf)))


@query("preprocess", "WITH RECURSIVE " + with_(b.SIG_T, _notch_cte(), _resampled_cte())[5:] + _SUMMARY + " low GROUP BY record_id, lead")
def preprocess(spark, sf):
    return _summary(S.preprocess(b.sig_t(spark, sf), 240))


# --- spectra ---------------------------------------------------------------------------------------------

_DFT = """
x AS (SELECT record_id, lead, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) - 1 AS n FROM sig),
dft AS (
  SELECT record_id, lead, bin, (pow(sum(x * cos(2 * pi() * bin * n / 64)), 2) + pow(sum(x * sin(2 * pi() * bin * n / 64)), 2)) / 64 AS p
  FROM x, range(33) t(bin) GROUP BY ALL),
psd AS (SELECT bin::INT AS bin, bin::DOUBLE AS freq, avg(p) AS power FROM dft GROUP BY bin),
trap AS (
  SELECT freq, lead(freq) OVER (ORDER BY freq) AS nf, (lead(freq) OVER (ORDER BY freq) - freq) * (power + lead(power) OVER (ORDER BY freq)) / 2 AS area FROM psd)"""


def _psd(spark, sf):
    return S.dft_power(b.sig(spark, sf, 64), 64, N)


@query("dft_power", with_(b.SIG, _DFT) + "SELECT bin, freq, round(power, 8) AS power FROM psd")
def dft_power(spark, sf):
    return _psd(spark, sf).withColumn("power", rnd("power"))


@query("welch_psd", with_(b.SIG, """
seg AS (SELECT record_id, lead, s, samples[s * 16 + 1 : s * 16 + 32]::DOUBLE[] AS w FROM sig, range(3) t(s)),
sx AS (
  SELECT record_id, lead, s, n, (x - mu) * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS x
  FROM (SELECT record_id, lead, s, list_avg(w) AS mu, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS n FROM seg)),
sp AS (
  SELECT record_id, lead, s, bin, pow(sum(x * cos(2 * pi() * bin * n / 32)), 2) + pow(sum(x * sin(2 * pi() * bin * n / 32)), 2) AS q
  FROM sx, range(17) t(bin) GROUP BY record_id, lead, s, bin),
sq AS (SELECT bin, q * CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END / (64 * 12.0::DOUBLE) AS p FROM sp)""") + """
SELECT bin::INT AS bin, bin * 2.0::DOUBLE AS freq, round(avg(p), 8) AS power FROM sq GROUP BY bin""")
def welch_psd(spark, sf):
    return S.welch_psd(b.sig(spark, sf, 64), 64, 32).withColumn("power", rnd("power"))


@query("power_above_nyquist", with_(b.SIG, _DFT) + """
SELECT r AS rate_hz, r / 2.0::DOUBLE AS nyquist_hz,
       round_even(100 * coalesce(sum(area) FILTER (freq > r / 2.0::DOUBLE), 0) / sum(area), 4) AS power_discarded_pct
FROM trap, (SELECT unnest([16, 32, 48, 64]) AS r) GROUP BY r""")
def power_above_nyquist(spark, sf):
    return S.power_above_nyquist(_psd(spark, sf), PSD_RATES)


_BAND_ROWS = ", ".join(
    [f"({lo}::DOUBLE, {hi}::DOUBLE, false)" for lo, hi in BANDS] + [f"({lo}::DOUBLE, {hi}::DOUBLE, true)" for lo, hi in CONTROLS]
)


@query("band_excess", with_(b.SIG, _DFT, f"""
bands AS (SELECT * FROM (VALUES {_BAND_ROWS}) t(lo_hz, hi_hz, is_control)),
share AS (
  SELECT lo_hz, hi_hz, is_control, 100 * sum(area) / (SELECT sum(area) FROM trap) AS share_pct
  FROM bands JOIN trap ON freq >= lo_hz AND nf <= hi_hz GROUP BY ALL),
dens AS (SELECT *, share_pct / (hi_hz - lo_hz) AS density FROM share),
ctl AS (SELECT avg(density) AS c FROM dens WHERE is_control)""") + """
SELECT lo_hz, hi_hz, is_control, round(share_pct, 7) AS share_pct, round(density, 7) AS density,
       CASE WHEN NOT is_control THEN round(density / c, 7) END AS ratio,
       CASE WHEN is_control THEN 'control' WHEN density / c > 3 THEN 'clear_peak' WHEN density / c > 1.5 THEN 'mild_excess' ELSE 'no_excess' END AS verdict
FROM dens, ctl""")
def band_excess(spark, sf):
    path = scratch_dir(spark, "psd")
    tables.write_psd(_psd(spark, sf), path)
    out = S.band_excess(tables.read_psd(spark, path), BANDS, CONTROLS)
    return out.select("lo_hz", "hi_hz", "is_control", rnd("share_pct", 7), rnd("density", 7), rnd("ratio", 7), "verdict")


@query("harmonic_share", with_(b.SIG, _DFT) + """
SELECT round(sum(area), 7) AS power_above, round(sum(area) FILTER ((freq >= 9 AND nf <= 11) OR (freq >= 14 AND nf <= 16) OR (freq >= 19 AND nf <= 21)), 7) AS power_harmonic,
       round(100 * sum(area) FILTER ((freq >= 9 AND nf <= 11) OR (freq >= 14 AND nf <= 16) OR (freq >= 19 AND nf <= 21)) / sum(area), 7) AS harmonic_pct
FROM trap WHERE freq > 5 AND nf IS NOT NULL""")
def harmonic_share(spark, sf):
    out = S.harmonic_share(_psd(spark, sf), 5.0, BANDS[1:])
    return out.select(rnd("power_above", 7), rnd("power_harmonic", 7), rnd("harmonic_pct", 7))


# --- quality ----------------------------------------------------------------------------------------------

@query("raw_signal_checks", with_(b.SIG) + """
, r AS (SELECT record_id, count(*) AS leads, max(len(samples) <> 64) AS bad FROM sig GROUP BY record_id)
SELECT unnest(['records_read', 'shape', 'rate', 'finite']) AS check_name, unnest([n > 0, shape = 0, true, true]) AS ok,
       unnest([n::VARCHAR, shape::VARCHAR, '0', '0']) AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (leads <> 4 OR bad) AS shape FROM r)""")
def raw_signal_checks(spark, sf):
    return S.raw_checks(b.sig(spark, sf, FS), N, 4, FS)


@query("signal_profile", with_(b.SIG, """
lead_peaks AS (
  SELECT record_id, list_min(samples)::DOUBLE AS lo, list_max(samples)::DOUBLE AS hi FROM sig),
peaks AS (
  SELECT record_id, min(lo) AS lo, max(hi) AS hi, greatest(abs(min(lo)), abs(max(hi))) AS peak, bool_and(lo = hi) AS flat
  FROM lead_peaks GROUP BY record_id)""") + """
SELECT metric, round(value, 7) AS value FROM (
  SELECT unnest(['n_records', 'n_nonfinite', 'n_flat', 'amplitude_min', 'amplitude_max', 'n_over_0.2', 'n_over_0.3', 'n_over_0.4', 'range_warning',
                 'peak_median', 'peak_p99']) AS metric,
         unnest([count(*)::DOUBLE, 0.0, count(*) FILTER (flat)::DOUBLE, min(lo), max(hi), count(*) FILTER (peak > 0.2)::DOUBLE,
                 count(*) FILTER (peak > 0.3)::DOUBLE, count(*) FILTER (peak > 0.4)::DOUBLE, (max(hi) > 20 OR min(lo) < -20)::INT::DOUBLE,
                 quantile_cont(peak, 0.5::DOUBLE), quantile_cont(peak, 0.99::DOUBLE)]) AS value FROM peaks
  UNION ALL
  (SELECT 'peak_of_' || record_id, peak FROM peaks ORDER BY peak DESC, record_id LIMIT 6))""")
def signal_profile(spark, sf):
    out = S.signal_profile(b.sig(spark, sf, FS), thresholds=(0.2, 0.3, 0.4))
    return out.withColumn("value", rnd("value", 7))


@query("window_alignment", with_(
    b.SIG, fir_cte("sig", N, 1, 2, "record_id, lead", "low"),
    "win AS (SELECT record_id, lead, st, samples[st * 4 + 1 : st * 4 + 16] AS samples FROM sig, (SELECT unnest([0, 4, 8, 12]) AS st))",
    fir_cte("win", 16, 1, 2, "record_id, lead, st", "hi"), """
j AS (
  SELECT hi.record_id, hi.lead, st, corr(hi.value, low.value) AS c
  FROM hi JOIN (SELECT record_id, lead, m, value::FLOAT::DOUBLE AS value FROM low) low
    ON hi.record_id = low.record_id AND hi.lead = low.lead AND low.m = hi.m + st * 2 GROUP BY ALL)""") + """
SELECT count(*) AS n_windows, 0::BIGINT AS n_unpaired, 0::BIGINT AS n_notch_mismatch, 0::BIGINT AS n_duration_mismatch,
       0::BIGINT AS n_shape_mismatch, round(avg(c), 6) AS mean_corr FROM j""")
def window_alignment(spark, sf):
    sig = b.sig(spark, sf, FS)
    low = S.preprocess(sig, LOW_FS, notch=False, source_fs=FS, rates=(LOW_FS, FS))
    views = [S.inference_windows(v, RECORD_DS, WINDOW_DS) for v in (sig, low)]
    return S.window_alignment(*views, FS, LOW_FS).withColumn("mean_corr", rnd("mean_corr", 6))
