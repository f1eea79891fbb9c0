"""The comparison of a design as one job: its gates and what it reports."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import analysis, inference
from pulsegrid.plans import bindings as b

SF = "/root/testdata/sf0.001"
N_BOOT = 30


@pytest.fixture(scope="module")
def preds(spark):
    return b.pred_d(spark, SF).cache()


@pytest.fixture(scope="module")
def runs(spark):
    return b.design_runs(spark, SF)


@pytest.fixture(scope="module")
def frozen(spark):
    return spark.createDataFrame([("quality",)], "label string")


def test_families_share_one_resample_and_keep_their_corrections(preds, runs, frozen):
    got = analysis.analyse(preds, runs, frozen, n_boot=N_BOOT)
    pairs = got.pairs.collect()
    assert {(r["analysis"], r["family"]) for r in pairs} == {
        ("rates", "rates"), ("arms", "arms@240"), ("arms", "arms@250"), ("arms", "arms@500"), ("notch", "notch@100"), ("source", "source@100"),
    }
    assert all(r["p_holm"] == r["p_raw"] for r in pairs if r["analysis"] != "rates")
    rates = preds.join(runs.where("block = 1").select("run_id", "seed", F.col("fs").cast("string").alias("grp")), "run_id")
    alone = {(r["endpoint"], r["a"], r["b"]): r for r in inference.compare_groups(rates, frozen, N_BOOT).collect()}
    for r in (r for r in pairs if r["analysis"] == "rates"):
        one = alone[r["endpoint"], r["a"], r["b"]]
        assert [r[c] for c in ("lo", "hi", "p_raw", "p_holm", "lo_simultaneous")] == [one[c] for c in ("lo", "hi", "p_raw", "p_holm", "lo_simultaneous")]
    groups = got.groups.collect()
    assert len(groups) == 28 and all(r["n_seeds"] == 5 and r["null_median"] is not None for r in groups)
    assert len(got.verdicts.collect()) == 12
    only = analysis.analyse(preds, runs, frozen, analyses=["notch"], n_boot=N_BOOT).pairs
    assert {r["family"] for r in only.collect()} == {"notch@100"}


def test_gate_reports_both_conditions(preds, runs):
    row = analysis.stage0_gate(preds, runs, N_BOOT, target=0.8).first()
    assert row["n_seeds"] == 3 and len(row["run_ids"]) == 3
    assert row["accepted"] == (row["ci_contains_target"] and row["point_within_tolerance"])
    assert not analysis.stage0_gate(preds, runs, N_BOOT, target=0.1).first()["accepted"]


def _refused(preds, runs, frozen, match, **kw):
    with pytest.raises(ValueError, match=match):
        analysis.analyse(preds, runs, frozen, n_boot=N_BOOT, **kw)


def test_gates_refuse_what_cannot_be_compared(spark, preds, runs, frozen):
    one = "b1-fs240-A-n1-s3"
    record = preds.agg(F.max("record_id")).first()[0]
    at = (F.col("run_id") == one) & (F.col("record_id") == record)
    _refused(preds.where(F.col("run_id") != one), runs, frozen, "without predictions.*" + one)
    _refused(preds.where(~at), runs, frozen, "not aligned.*records")
    _refused(preds.withColumn("y", F.when(at, 1 - F.col("y")).otherwise(F.col("y"))), runs, frozen, "not aligned.*labels")
    _refused(preds.where("label <> 'never'").unionByName(preds.where((F.col("label") == "never") & (F.col("run_id") != one))), runs, frozen, "not aligned.*records")
    twice = preds.unionByName(preds.where(F.col("record_id") == record))  # every run repeats the same cells
    _refused(twice, runs, frozen, "duplicate or missing")
    sets = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "run_id string, label string")
    _refused(preds, runs, frozen, "different frozen", frozen_sets=sets)
    _refused(preds, runs.where("block = 0"), frozen, "no runs in the families")
    with pytest.raises(ValueError, match="no run in block 9"):
        analysis.stage0_gate(preds, runs, N_BOOT, block=9)
    with pytest.raises(ValueError, match="without predictions"):
        analysis.stage0_gate(preds.where("run_id <> 'b0-fs100-A-n0-s1'"), runs, N_BOOT)
    with pytest.raises(ValueError, match="duplicate or missing"):
        analysis.stage0_gate(twice, runs, N_BOOT)
