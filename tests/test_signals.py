import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import exprs, format16, kernels
from pulsegrid.operators import signals as S
from pulsegrid.sources import signals as store, tables

N = 5000


def waves(rows=3, seed=0, mains=0.4):
    rng = np.random.default_rng(seed)
    t = np.arange(N) / 500
    x = np.stack([
        sum(np.sin(2 * np.pi * f * t + rng.random() * 6) for f in (1.2, 4, 9)) + mains * np.sin(2 * np.pi * 50 * t) for _ in range(rows)
    ])
    return x / 2


def level(x, f, fs):
    """Amplitude of one frequency."""
    t = np.arange(x.shape[-1]) / fs
    return 2 * np.abs((x * np.exp(-2j * np.pi * f * t)).mean(axis=-1))


@pytest.fixture(scope="module")
def sig(spark):
    x = waves(24)
    pdf = pd.DataFrame({
        "record_id": np.repeat([10, 20], 12), "lead": np.tile(np.arange(12), 2), "fs": 500, "notch": False, "source": "hr",
        "fold": np.repeat([1, 10], 12), "samples": [r.tolist() for r in x.astype(np.float32)],
    })
    return spark.createDataFrame(pdf, "record_id long, lead int, fs int, notch boolean, source string, fold int, samples array<float>").cache()


# --- kernels against their definitions ------------------------------------------------------------

def test_notch_removes_mains_and_keeps_the_band():
    x = waves()
    y = kernels.notch(x)
    assert (level(y, 50, 500) < 0.1 * level(x, 50, 500)).all()
    for f in (1.2, 4, 9):
        ratio = level(y, f, 500) / level(x, f, 500)
        assert ((ratio > 0.9) & (ratio < 1.1)).all()


def test_zero_phase_matches_a_plain_recurrence():
    x = waves(1)[0, :400]
    b, a = kernels.notch_coefficients(50, 30, 500)
    ext = np.concatenate([2 * x[0] - x[9:0:-1], x, 2 * x[-1] - x[-2:-11:-1]])

    def direct(u):
        # constant past at the first value, i.e. the steady state of a filter with unit gain at 0 Hz
        y, past_u, past_y = [], [u[0], u[0]], [u[0], u[0]]
        for v in u:
            w = b[0] * v + b[1] * past_u[0] + b[2] * past_u[1] - a[1] * past_y[0] - a[2] * past_y[1]
            past_u, past_y = [v, past_u[0]], [w, past_y[0]]
            y.append(w)
        return np.array(y)

    want = direct(direct(ext)[::-1])[::-1][9:-9]
    assert np.allclose(kernels.notch(x[None])[0], want, atol=1e-10)


def test_time_reversal_commutes_with_the_zero_phase_filter():
    x = waves(2)
    inner = slice(1500, 3500)
    assert np.allclose(kernels.notch(x)[:, inner], kernels.notch(x[:, ::-1])[:, ::-1][:, inner], atol=1e-4)


@pytest.mark.parametrize("up,down", [(1, 5), (12, 25), (1, 2)])
def test_resampling_matches_the_sum(up, down):
    x = waves(2)[:, :300]
    h = kernels.resample_taps(up, down)
    half = len(h) // 2
    got = kernels.resample(x, up, down)
    for m in (0, 1, got.shape[1] // 2, got.shape[1] - 1):
        total = sum(x[:, n] * h[m * down - n * up + half] for n in range(300) if 0 <= m * down - n * up + half < len(h))
        assert np.allclose(got[:, m], total, atol=1e-12)


def test_resampled_lengths_and_content():
    x = waves(mains=0.0)
    for fs, n in ((100, 1000), (240, 2400), (250, 2500), (500, 5000)):
        y = kernels.resample(x, *kernels.rate_factors(500, fs))
        assert y.shape[1] == n
        assert np.allclose(level(y, 4, fs), level(x, 4, 500), rtol=0.02)


def test_welch_total_power_is_the_variance():
    x = np.random.default_rng(1).normal(size=(4, 20000))
    p = kernels.welch(x, 500, 1000)
    assert p.shape == (4, 501)
    assert np.allclose(p.sum(axis=1) * 0.5, 1.0, atol=0.05)


# --- grid and windows ------------------------------------------------------------------------------------

def test_rates_and_lengths():
    S.check_rates()
    assert [exprs.whole_samples(25, fs) for fs in S.RATES] == [250, 600, 625, 1250]
    starts = S.crop_starts()
    assert (len(starts), starts[0], starts[-1]) == (76, 0, 75) and S.tiling_starts() == [0, 25, 50, 75]
    with pytest.raises(ValueError, match="whole number"):
        S.check_rates(rates=(125,))
    with pytest.raises(ValueError, match="tile"):
        S.check_rates(window_ds=30)


def test_grid_is_tested_before_integrality(spark):
    df = spark.createDataFrame([(50, fs) for fs in S.RATES], "ms int, fs int")
    assert {r[0] for r in df.select(exprs.grid_status("ms", "fs")).collect()} == {"off_grid"}
    with pytest.raises(Exception, match="off the 0.1 s grid"):
        df.select(exprs.decisecond_index("ms", "fs")).collect()
    ok = spark.createDataFrame([(2500, fs) for fs in S.RATES], "ms int, fs int")
    assert [r[0] for r in ok.select(exprs.decisecond_index("ms", "fs")).collect()] == [250, 600, 625, 1250]


def test_windows_tile_the_record_and_refuse_the_outside(sig):
    w = S.inference_windows(sig.where("record_id = 10 and lead = 0"))
    parts = [r["samples"] for r in w.orderBy("start_ds").collect()]
    whole = sig.where("record_id = 10 and lead = 0").first()["samples"]
    assert [v for p in parts for v in p] == whole
    for start, message in ((80, "leaves the record"), (-1, "leaves the record")):
        with pytest.raises(Exception, match=message):
            S.crop(sig.withColumn("start_ds", F.lit(start)), 25).collect()


def test_seeded_starts_do_not_depend_on_the_rate(spark, sig):
    low = S.preprocess(sig, 100, notch=False)
    start = lambda df, seed, epoch: {(r["record_id"], r["lead"]): r["start_ds"] for r in S.seeded_crop(df, seed, epoch).collect()}
    assert start(sig, 0, 3) == start(low, 0, 3)
    many = spark.range(0, 5000).selectExpr("id record_id")
    got = [r[0] for r in many.select(S.seeded_start(0, 1)).collect()]
    other = [r[0] for r in many.select(S.seeded_start(0, 2)).collect()]
    assert set(got) == set(range(76)) and got != other


# --- preprocessing and alignment ---------------------------------------------------------------------------

def test_preprocess_order_and_guards(sig):
    got = S.preprocess(sig, 100)
    row = got.where("record_id = 10 and lead = 3").first()
    x = np.asarray(sig.where("record_id = 10 and lead = 3").first()["samples"], dtype=np.float64)[None]
    want = kernels.resample(kernels.notch(x), 1, 5)[0].astype(np.float32)
    assert np.array_equal(np.asarray(row["samples"], dtype=np.float32), want) and row["fs"] == 100 and row["notch"]
    with pytest.raises(ValueError, match="not in the protocol"):
        S.resample(sig, 300)
    with pytest.raises(ValueError, match="before resampling"):
        S.notch_filter(sig, fs=250)


def test_views_of_one_signal_align(sig):
    views = {fs: S.inference_windows(S.preprocess(sig, fs)) for fs in (100, 500)}
    report = S.window_alignment(views[500], views[100], 500, 100)
    r = report.first()
    assert r["n_windows"] == 96 and r["mean_corr"] > 0.95
    S.refuse_misaligned(report)
    other = S.window_alignment(views[500], views[100].withColumn("record_id", 30 - F.col("record_id")), 500, 100)
    with pytest.raises(ValueError, match="correlation"):
        S.refuse_misaligned(other)
    late = S.window_alignment(views[500], views[100].where("start_ds > 0"), 500, 100, check_signal=False)
    assert late.first()["n_unpaired"] == 24
    flat = views[100].withColumn("samples", F.transform("samples", lambda v: F.lit(0.0).cast("float")))
    assert S.window_alignment(views[500], flat, 500, 100).first()["mean_corr"] == 0.0
    with pytest.raises(ValueError, match="same rate"):
        S.window_alignment(views[100], views[100], 100, 100)


# --- scaler ------------------------------------------------------------------------------------------------------

def test_scaler_uses_training_folds_only_and_is_stable(sig):
    shifted = sig.withColumn("samples", F.transform("samples", lambda v: (v.cast("double") + 1e6)))
    x = np.stack([np.asarray(r["samples"]) for r in shifted.where("fold <= 8").collect()])
    a = S.fit_scaler(shifted).first()
    z = S.fit_scaler(shifted.repartition(9)).first()
    assert a["n_values"] == x.size and a["record_fingerprint"] == z["record_fingerprint"]
    assert a["mean"] == pytest.approx(x.mean(), rel=1e-12) and a["std"] == pytest.approx(x.std(), rel=1e-9)
    assert z["std"] == pytest.approx(a["std"], rel=1e-9)


def test_standardise(sig, tmp_path, spark):
    scaler = S.fit_scaler(sig)
    got = S.standardise(sig.where("fold <= 8"), scaler).select(F.explode("samples").alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(1, abs=1e-6)
    with pytest.raises(Exception, match="degenerate"):
        S.standardise(sig, scaler.withColumn("std", F.lit(0.0))).collect()
    tables.write_json(scaler, str(tmp_path / "s"))
    assert tables.read_scalers(spark, str(tmp_path / "s")).first()["mean"] == scaler.first()["mean"]
    tables.write_json(scaler.withColumn("version", F.lit(9)), str(tmp_path / "v"))
    with pytest.raises(Exception, match="version"):
        tables.read_scalers(spark, str(tmp_path / "v")).collect()


def test_scaler_choice(spark, sig):
    runs = spark.createDataFrame([("b0", 0, 100, False), ("b1", 1, 240, True), ("b3", 3, 100, False)], "run_id string, block int, fs int, notch boolean")
    stored = S.fit_scaler(sig).withColumn("notch", F.lit(True))
    got = {r["run_id"]: (r["fit_fs"], r["fit_notch"], r["status"]) for r in S.resolve_scaler(runs, stored).collect()}
    assert got == {"b0": (100, False, "fit"), "b1": (500, True, "reuse"), "b3": (500, True, "reuse")}
    want = spark.createDataFrame([(500, True, "feed")], "fs int, notch boolean, fingerprint string")
    assert {r["status"] for r in S.resolve_scaler(runs.where("block > 0"), stored, want).collect()} == {"wrong_provenance"}


# --- spectra -------------------------------------------------------------------------------------------------------

def test_spectrum_leaves_out_records_with_gaps(spark, sig):
    psd = S.welch_psd(sig).toPandas().sort_values("freq")
    x = np.stack([np.asarray(r["samples"], dtype=np.float64) for r in sig.collect()])
    assert np.allclose(psd["power"], kernels.welch(x, 500, 1000).mean(axis=0), rtol=1e-9)
    broken = sig.withColumn("samples", F.when(
        (F.col("record_id") == 20) & (F.col("lead") == 5), F.transform("samples", lambda v: F.lit(float("nan")).cast("float"))
    ).otherwise(F.col("samples")))
    kept = S.welch_psd(broken).toPandas().sort_values("freq")
    one = np.stack([np.asarray(r["samples"], dtype=np.float64) for r in sig.where("record_id = 10").collect()])
    assert np.allclose(kept["power"], kernels.welch(one, 500, 1000).mean(axis=0), rtol=1e-9)


def test_bands(spark):
    f = np.arange(0, 250.5, 0.5)
    p = 1.0 + 9.0 * ((f >= 95) & (f <= 105))
    psd = spark.createDataFrame([(float(a), float(b)) for a, b in zip(f, p)], "freq double, power double")
    total = np.trapezoid(p, f)
    nyq = {r["rate_hz"]: r["power_discarded_pct"] for r in S.power_above_nyquist(psd).collect()}
    assert nyq[500] == 0.0 and nyq[250] == pytest.approx(100 * 124.5 / total, abs=1e-4)
    bands = {(r["lo_hz"], r["verdict"]) for r in S.band_excess(psd).collect()}
    assert {(95.0, "clear_peak"), (45.0, "no_excess"), (60.0, "control")} <= bands
    r = S.harmonic_share(psd).first()
    assert r["power_harmonic"] == pytest.approx(100 + 20)  # summed per band, nothing across the gaps


# --- checks, store, ingest ----------------------------------------------------------------------------------------------

def test_raw_checks_and_profile(sig):
    assert all(r["ok"] for r in S.raw_checks(sig, N, 12, 500).collect())
    bad = {r["check_name"]: r["detail"] for r in S.raw_checks(sig.where("lead < 11 or record_id = 10"), N, 12, 250).collect()}
    assert (bad["shape"], bad["rate"]) == ("1", "2")
    got = {r["metric"]: r["value"] for r in S.signal_profile(sig).collect()}
    x = np.stack([np.asarray(r["samples"]) for r in sig.orderBy("record_id", "lead").collect()]).reshape(2, -1)
    peaks = np.abs(x).max(axis=1)
    assert got["peak_median"] == pytest.approx(np.median(peaks)) and got["peak_p99"] == pytest.approx(np.percentile(peaks, 99))
    assert (got["n_records"], got["n_flat"], got["n_nonfinite"], got["range_warning"]) == (2, 0, 0, 0)
    flat = sig.withColumn("samples", F.transform("samples", lambda v: F.lit(1.0).cast("float")))
    assert {r["metric"]: r["value"] for r in S.signal_profile(flat).collect()}["n_flat"] == 2


def test_store_is_idempotent_and_refuses_other_records(spark, sig, tmp_path):
    root = str(tmp_path / "store")
    rows = S.preprocess(sig, 100).drop("fs", "notch", "source")
    args = dict(source="hr", fs=100, notch=True, n_samples=1000)
    assert store.write_signals(rows, root, **args)
    assert not store.write_signals(rows, root, **args)
    assert store.write_signals(rows, root, overwrite=True, **args)
    got = store.read_signals(spark, root, rates=[100], records=sig)
    assert got.count() == 24 and got.first()["notch"] is True
    assert S.compare_stored(got, rows).first().asDict() == {"n_rows": 24, "n_incomparable": 0, "max_abs_diff": 0.0}
    with pytest.raises(FileNotFoundError, match="other records"):
        store.read_signals(spark, root, rates=[100], records=sig.where("record_id = 10"))
    with pytest.raises(FileNotFoundError, match="no coherent store"):
        store.read_signals(spark, root, rates=[100, 240])
    assert store.write_signals(rows.where("record_id = 10"), root, **args)  # another set is rebuilt
    with pytest.raises(Exception, match="2400 samples"):
        store.write_signals(rows, root, source="hr", fs=240, notch=True, n_samples=2400)


def test_ingest_reads_real_files(spark, sig, tmp_path):
    x = waves(12)
    for name in ("00001", "00002"):
        head, blob = format16.encode(name, 500, x)
        (tmp_path / f"{name}.hea").write_text(head)
        (tmp_path / f"{name}.dat").write_bytes(blob)
    files = tables.read_files(spark, str(tmp_path), "*.{hea,dat}")
    got = store.ingest_signals(files, n_leads=12, n_samples=N)
    assert got.count() == 24
    row = got.where("lead = 4 and stem like '%00002'").first()
    assert np.abs(np.asarray(row["samples"]) - x[4]).max() <= 0.0005 and (row["fs"], row["lead_name"]) == (500, "L4")
    with pytest.raises(Exception, match="leads instead of 8"):
        store.ingest_signals(files, n_leads=8).collect()


def test_header_variants():
    head = format16.parse_header("# c\nrec/1 2 250/9 10\nrec.dat 16 200.5(-3)/uV 12 7 0 0 0 II\nrec.dat 16 0 12 7\n")
    assert (head["gain"], head["baseline"], head["lead"], head["fs"]) == ([200.5, 200.0], [-3, 7], ["II", "1"], 250.0)
    with pytest.raises(ValueError, match="format 16"):
        format16.parse_header("r 1 250 10\nr.dat 212 200 12 0\n")
    assert np.isnan(format16.decode({"record": "r", "n_samples": 1, "gain": [1.0], "baseline": [0]}, b"\x00\x80")).all()


def test_scaler_joins_lose_and_repeat_nothing(spark):
    from pyspark.errors import SparkRuntimeException

    signals = spark.createDataFrame([(1, 0, 100, True, "hr", [1.0, 3.0]), (2, 0, 200, True, "hr", [1.0])], "record_id int, lead int, fs int, notch boolean, source string, samples array<float>")
    scaler = spark.createDataFrame([(100, True, "hr", 1.0, 2.0)], "fs int, notch boolean, source string, mean double, std double")
    assert S.standardise(signals.where("fs = 100"), scaler).first()["samples"] == [0.0, 1.0]
    with pytest.raises(SparkRuntimeException):
        S.standardise(signals, scaler).collect()
    runs = spark.createDataFrame([("a", 0, 100, False), ("b", 1, 100, True), ("c", 0, 250, False)], "run_id string, block int, fs int, notch boolean")
    row = lambda fs, notch, source: (fs, notch, source, "full_record", "1-8", "f", 0.0, 1.0)
    schema = "fs int, notch boolean, source string, window string, folds string, record_fingerprint string, mean double, std double"
    stored = spark.createDataFrame([row(500, True, "hr"), row(500, True, "lr"), row(100, False, "lr")], schema)
    got = {r["run_id"]: r["status"] for r in S.resolve_scaler(runs, stored).collect()}
    assert got == {"a": "wrong_provenance", "b": "reuse", "c": "fit"} and S.resolve_scaler(runs, stored).count() == 3
    with pytest.raises(SparkRuntimeException):
        S.resolve_scaler(runs, stored.unionByName(stored)).collect()
