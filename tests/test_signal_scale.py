"""Block filters, mergeable moments, summed spectra and files by source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import format16, kernels
from pulsegrid.operators import signals as S
from pulsegrid.sources import signals as store


def plain_biquad(x, b, a):
    """The recurrence sample by sample."""
    dc = b.sum() / a.sum()
    z2 = (b[2] - a[2] * dc) * x[0]
    z1 = (b[1] - a[1] * dc) * x[0] + z2
    y = np.empty_like(x)
    for t in range(len(x)):
        y[t] = b[0] * x[t] + z1
        z1 = b[1] * x[t] - a[1] * y[t] + z2
        z2 = b[2] * x[t] - a[2] * y[t]
    return y


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200, 5000])
def test_block_filter_is_the_plain_recurrence(n):
    rng = np.random.default_rng(n)
    for f0, q, fs in ((50.0, 30.0, 500.0), (60.0, 5.0, 250.0)):
        b, a = kernels.notch_coefficients(f0, q, fs)
        x = rng.normal(0, 3, (n, 7)) + 1e3
        assert np.abs(kernels._biquad(x, b, a) - plain_biquad(x, b, a)).max() < 1e-10 * 1e3


def test_moments_hold_with_a_large_offset_and_rows_of_any_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, 40, i % 2 == 0, "hr", 1 + i % 10, (rng.normal(0, 1e-3, rng.integers(0, 90)) + 1e6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id long, lead int, fs int, notch boolean, source string, fold int, samples array<double>").repartition(5)
    got = {r["notch"]: r for r in S.fit_scaler(df).collect()}
    for notch in (True, False):
        v = np.concatenate([r[6] for r in rows if r[3] == notch and r[5] <= 8])
        assert got[notch]["n_values"] == len(v)
        assert got[notch]["mean"] == pytest.approx(v.mean(), abs=1e-9) and got[notch]["std"] == pytest.approx(np.std(v - 1e6), rel=1e-6)
    again = {r["notch"]: r["record_fingerprint"] for r in S.fit_scaler(df.coalesce(1)).collect()}
    assert again == {k: r["record_fingerprint"] for k, r in got.items()}
    one = S.fit_scaler(spark.createDataFrame([(1, 0, 40, True, "hr", 1, [1.0, None, 3.0]), (2, 0, 40, True, "hr", 1, None)], df.schema)).first()
    assert (one["n_values"], one["mean"], one["std"]) == (2, 2.0, 1.0)


def test_mean_spectrum_weighs_records_alike_and_drops_bad_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(r, lead, rng.normal(0, 1, 64).tolist()) for r in range(12) for lead in range(2 + (r == 3))]
    rows += [(90, 0, [float("nan")] * 64), (90, 1, [1.0] * 64)]
    df = spark.createDataFrame(rows, "record_id long, lead int, samples array<double>").repartition(4)
    want = np.mean([np.mean([np.abs(np.fft.rfft(x)) ** 2 / 64 for i, _, x in rows if i == r], axis=0) for r in range(12)], axis=0)
    got = S.dft_power(df, 64.0, 64).orderBy("bin").collect()
    assert [r["power"] for r in got] == pytest.approx(list(want)) and [r["freq"] for r in got] == [float(i) for i in range(33)]
    plan = S.dft_power(df, 64.0, 64)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "bin" in moved[0]  # vectors of tasks, no samples


def test_files_are_found_by_the_path_of_the_chosen_source(spark, tmp_path):
    raw = np.array([[100, -200], [300, -32768], [0, 50]], dtype="<i2")  # three samples of two leads
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/r1_lr.dat").write_bytes(raw.tobytes())
    (tmp_path / "a/b/r1_lr.hea").write_text("r1_lr 2 100 3\nr1_lr.dat 16 200(100)/mV 16 0 0 0 0 I\nr1_lr.dat 16 0/mV 16 -50 0 0 0 II\n# end\n")
    records = spark.createDataFrame([("one", "gone", "a/b/r1_lr", 1)], "record_id string, filename_hr string, filename_lr string, lead int")
    got = store.read_signal_files(records, str(tmp_path), "lr", n_leads=2, n_samples=3)
    rows = got.orderBy("lead").collect()
    assert [(r["record_id"], r["source"], r["lead"], r["lead_name"], r["fs"]) for r in rows] == [("one", "lr", 0, "I", 100), ("one", "lr", 1, "II", 100)]
    assert rows[0]["samples"] == [0.0, 1.0, -0.5]
    assert rows[1]["samples"][0] == -0.75 and np.isnan(rows[1]["samples"][1]) and rows[1]["samples"][2] == 0.5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "samples" not in plan.split("MapInArrow")[1].split("\n", 1)[1]  # nothing below the reader carries payloads
    for bad, match in ((lambda: store.read_signal_files(records, str(tmp_path), "hr"), "gone"),
                       (lambda: store.read_signal_files(records, str(tmp_path), "lr", n_leads=12), "2 leads instead of 12"),
                       (lambda: store.read_signal_files(records.withColumn("filename_lr", F.lit(None).cast("string")), str(tmp_path), "lr"), "no path of source")):
        with pytest.raises(Exception, match=match):
            bad().collect()
    with pytest.raises(ValueError, match="unknown signal source"):
        store.read_signal_files(records, str(tmp_path), "xr")
    assert format16.parse_header("r 1 500 2\nr.dat 16\n")["gain"] == [200.0]


def test_records_are_held_to_their_own_leads(spark, tmp_path):
    """Records with fewer leads than others, and with a gap between them, come back whole under their numbers."""
    from pulsegrid.plans.catalog import QUERIES

    # the last record of a table that ends inside it, and one without its lead 1
    rows = [(i, [float(i % 50)] * 64, i % 10) for i in range(10) if i != 5]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted((i // 4, i % 4) for i, _, _ in rows)
    got = QUERIES["ingest_signals"](spark, str(tmp_path)).where("m = 63").collect()
    assert sorted((int(r["stem"]), r["lead"]) for r in got) == want and all(r["value"] == 4 * int(r["stem"]) + r["lead"] for r in got)
    got = QUERIES["read_signal_files"](spark, str(tmp_path)).where("m = 31").collect()
    assert sorted((r["record_id"], r["lead"]) for r in got if r["source"] == "lr") == want
    assert all(r["value"] == 4 * r["record_id"] + r["lead"] and r["lead_name"] == f"L{r['lead']}" for r in got)
    held = store.encode_signals(spark.createDataFrame([(0, 0, 40, [1.0, 2.0])], "record_id long, lead int, fs int, samples array<float>"))
    for leads in ([("record/00000", 2)], [("record/00001", 1)]):  # a lead is lost; no record of that name is declared
        with pytest.raises(Exception, match="1 leads instead of"):
            store.ingest_signals(held, spark.createDataFrame(leads, "stem string, n_leads long")).collect()


def test_samples_go_on_before_the_next_are_read(spark, monkeypatch):
    """A slice of rows leaves a kernel at a time, in order, whatever the lengths; the plan has no frame of a whole batch."""
    rows = [(i, "a" if i % 2 else None, [float(i)] * (5 + i % 3) + [None]) for i in range(700)]
    df = spark.createDataFrame(rows, "record_id long, note string, samples array<double>").coalesce(1)
    for element in ("float", "double"):
        got = S.map_samples(df, lambda x: np.append(x[:, :3] * 2, np.full((len(x), 1), len(x)), axis=1), element)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        kept = got.collect()
        assert [(r["record_id"], r["note"], r["samples"][:3]) for r in kept] == [(i, n, [2.0 * i] * 3) for i, n, _ in rows]
        assert max(r["samples"][3] for r in kept) <= S.KERNEL_ROWS / 2 and len(kept[0]["samples"]) == 4
    back = S.map_samples(df, lambda x: x, "double").orderBy("record_id").collect()
    assert [len(r["samples"]) for r in back] == [6 + i % 3 for i in range(700)] and np.isnan(back[0]["samples"][-1])
    with pytest.raises(Exception, match="a row without samples"):
        S.map_samples(spark.createDataFrame([(1, None)], "record_id long, samples array<double>"), lambda x: x).collect()
