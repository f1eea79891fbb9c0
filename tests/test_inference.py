import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decisions, inference, prefix, ranking

N_BOOT = 40


def seeded(n=60, groups=("100", "240", "500"), seeds=5, same=(), strength=None, seed=0):
    """Dyadic scores so that means over seeds are exact."""
    rng = np.random.default_rng(seed)
    y = {lab: (rng.random(n) < p).astype(int) for lab, p in (("a", 0.4), ("b", 0.2), ("never", 0.0))}
    rows, shared = [], {}
    for g in groups:
        for s in range(seeds):
            for lab, yy in y.items():
                noise = rng.integers(0, 1024, n)
                if g in same:
                    noise = shared.setdefault((s, lab), noise)
                shift = (strength or {}).get(g, 300)
                rows.append(pd.DataFrame({
                    "grp": g, "seed": s, "run_id": f"{g}-{s}", "record_id": np.arange(n) * 3, "label": lab, "y": yy,
                    "score": (yy * shift + noise) / 2048,
                }))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(seeded()).repartition(4).cache()


@pytest.fixture(scope="module")
def frozen(spark):
    return spark.createDataFrame([("a",)], "label string")


def test_weights_are_one_multinomial_per_replicate(spark):
    records = spark.range(0, 51).selectExpr("id * 2 record_id")
    w = inference.bootstrap_weights(records, 30).toPandas()
    assert (w.groupby("rep")["w"].sum() == 51).all() and w["rep"].nunique() == 30
    assert set(w["record_id"]) <= set(range(0, 102, 2)) and abs(w["w"].var() - 0.4) < 0.4
    again = inference.bootstrap_weights(records.repartition(9), 30).toPandas()
    key = ["rep", "record_id"]
    assert w.sort_values(key).values.tolist() == again.sort_values(key).values.tolist()


def test_weights_are_counts_of_the_md5_draws(monkeypatch):
    """Whatever is digested at once; the SQL's definition, one draw at a time."""
    for n in (1, 2, 37, 300):
        want = np.zeros((n, 3), dtype=int)
        for j, rep in enumerate((0, 5, 11)):
            for slot in range(n):
                digest = hashlib.md5(f"7:{rep}:{slot // 2}".encode()).hexdigest()
                want[int(digest[15 * (slot % 2) : 15 * (slot % 2) + 15], 16) % n, j] += 1
        for at_once in (1, 16, 1 << 18):
            monkeypatch.setattr(inference, "DIGESTS_AT_ONCE", at_once)
            assert (inference.replicate_weights(n, (0, 5, 11), 7) == want).all()


def test_no_draw_or_weight_is_shuffled(spark, preds, monkeypatch):
    """What moves to a task are packed predictions; narrower blocks give the same counts."""
    ens = ranking.ensemble(preds)
    got = inference.bootstrap_counts(ens, ["grp"], N_BOOT, cuts=(0.3,))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "md5" not in plan
    key = lambda df: sorted(map(tuple, df.select("rep", "grp", "label", "n_pos", "n_neg", "u2").collect()))
    whole = key(got)
    monkeypatch.setattr(inference, "WEIGHTS_PER_TASK", 120)  # two replicates of 60 records
    assert inference.block_width(spark, 60, N_BOOT) == 2
    assert key(inference.bootstrap_counts(ens, ["grp"], N_BOOT, cuts=(0.3,))) == whole


def test_no_copy_of_the_predictions_is_shuffled(spark, preds, monkeypatch):
    """Pieces are written once, whatever the number of blocks; each block is one task that reads them there."""
    sizes = []
    for held in (1 << 27, 60):  # few blocks, and one for each replicate of 60 records
        monkeypatch.setattr(inference, "WEIGHTS_PER_TASK", held)
        sample = inference.resample(ranking.ensemble(preds), ["grp"], N_BOOT, cuts=(0.3,))
        draws = inference._replicates(sample, ("u2 long",), inference._pairs, True)
        assert "Exchange" not in draws._jdf.queryExecution().executedPlan().toString()
        assert draws.rdd.getNumPartitions() == -(-N_BOOT // sample.width)
        assert draws.count() == 9 * (N_BOOT + 1)
        sizes.append((sample.pieces.count(), sample.pieces.agg(F.sum(F.length("idx"))).first()[0]))
    assert sizes == [(18, 4 * 9 * 60)] * 2


def test_weights_meet_their_records_across_rows_of_any_size(spark, monkeypatch):
    """Blocks of records and replicates end anywhere; keys of any type keep their order."""
    records = spark.range(0, 51).select(F.format_string("r%03d", F.col("id")).alias("k"))
    want = inference.replicate_weights(51, range(9), 3)
    want = sorted((r, f"r{i:03d}", int(want[i, r])) for i, r in np.ndindex(51, 9) if want[i, r])
    plans = []
    for per_row, held in ((4_096, 1 << 27), (7, 102)):
        monkeypatch.setattr(inference, "RECORDS_PER_ROW", per_row)
        monkeypatch.setattr(inference, "WEIGHTS_PER_TASK", held)
        got = inference.bootstrap_weights(records, 9, 3, "k")
        assert got.columns == ["rep", "k", "w"] and sorted(map(tuple, got.collect())) == want
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert all("md5" not in p for p in plans)  # no row per draw


def test_weights_are_neither_broadcast_nor_shuffled(spark, monkeypatch):
    """Spark knows nothing of their size, so they must not be a side of a join; a task per block opens them in slices."""
    records = spark.range(0, 51).selectExpr("id record_id")
    want = inference.replicate_weights(51, range(9))
    want = sorted((r, i, int(want[i, r])) for i, r in np.ndindex(51, 9) if want[i, r])
    monkeypatch.setattr(inference, "WEIGHTS_PER_TASK", 51 * 4)
    for per_row, at_once in ((4_096, 1 << 21), (4_096, 51 * 3), (20, 1)):
        monkeypatch.setattr(inference, "RECORDS_PER_ROW", per_row)
        monkeypatch.setattr(inference, "WEIGHTS_AT_ONCE", at_once)
        got = inference.bootstrap_weights(records, 9)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.rdd.getNumPartitions() == -(-9 // inference.block_width(spark, 51, 9))
        assert sorted(map(tuple, got.collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40  # nor taken for a small side by a later join
    assert inference.bootstrap_weights(records.limit(0), 9).count() == 0


def test_counts_do_not_depend_on_ranges(preds):
    """Ranges give the integers of one range, and those of the weighted scan over one row per replicate."""
    ens = ranking.ensemble(preds)
    weighted = inference.bootstrap_weights(ens, N_BOOT).join(ens, "record_id")
    forms = [inference.bootstrap_counts(ens, ["grp"], N_BOOT, cuts=c) for c in ((), (0.2, 0.3), (0.25, 0.3, 0.31, 0.5, 0.9))]
    forms.append(ranking.pair_counts(weighted, ["rep", "grp", "label"], weight="w", cuts=()))
    got = [sorted((*r[:3], *map(int, r[3:])) for r in f.select("rep", "grp", "label", "n_pos", "n_neg", "u2").collect()) for f in forms]
    assert len(got[0]) == N_BOOT * 9
    assert all(g == got[0] for g in got)


def test_records_may_have_keys_of_any_orderable_type(spark, preds, frozen):
    """String ids in the order of the numbers draw the same records."""
    text = preds.withColumn("record_id", F.format_string("r-%05d", "record_id"))
    a = inference.compare_groups(preds, frozen, N_BOOT).orderBy("endpoint", "a", "b").collect()
    z = inference.compare_groups(text, frozen, N_BOOT).orderBy("endpoint", "a", "b").collect()
    assert a == z and len(a) == 6
    days = spark.range(0, 40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    got = prefix.dense_index(days, "d").orderBy("d").collect()
    assert [r["idx"] for r in got] == list(range(40))


@pytest.mark.parametrize("cuts", [(), (0.2, 0.3, 0.31, 0.5)])
def test_replicates_of_precision_and_accuracy(spark, cuts):
    """States per range against the weighted scans over one row per prediction and replicate; the point is the plain metric."""
    ens = spark.createDataFrame(seeded(groups=("100", "500"), seeds=1, strength={"500": 700}))
    weighted = inference.bootstrap_weights(ens, N_BOOT).join(ens, "record_id")
    label = lambda df, *k: {tuple(r[c] for c in (*k, "label")): r["auprc"] for r in df.collect()}
    got = inference.bootstrap_precision(ens, ["grp"], N_BOOT, cuts=cuts, point=True)
    plain, drawn = label(got.where("rep < 0"), "grp"), label(got.where("rep >= 0"), "rep", "grp")
    assert plain == pytest.approx(label(ranking.label_scores(ens, ["grp", "label"], cuts=()), "grp"))
    assert drawn == pytest.approx(label(ranking.label_scores(weighted, ["rep", "grp", "label"], "w", cuts=()), "rep", "grp"))
    assert len(drawn) == N_BOOT * 6 and plain["100", "never"] is None
    got = inference.bootstrap_accuracy(ens, ["grp"], N_BOOT, cuts=cuts, point=True)
    want = ranking.accuracy_at(weighted, ["rep", "grp"], "w").union(ranking.accuracy_at(ens, ["grp"]).select(F.lit(-1), "grp", "accuracy"))
    assert {(r["rep"], r["grp"]): r["accuracy"] for r in got.collect()} == pytest.approx({(r[0], r[1]): r[2] for r in want.collect()})


def test_point_replicate_is_the_plain_figure(preds):
    got = inference.bootstrap_counts(preds, ["run_id"], 3, point=True).where("rep < 0")
    want = ranking.pair_counts(preds, ["run_id", "label"], cuts=())
    key = lambda df: sorted((r["run_id"], r["label"], int(r["n_pos"]), int(r["n_neg"]), int(r["u2"])) for r in df.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("cuts", [(), (0.5,)])
def test_counts_refuse_undefined_scores(spark, cuts):
    for bad in (None, float("nan")):
        rows = spark.createDataFrame([("g", 1, "a", 1, 0.2), ("g", 2, "a", 0, bad)], "grp string, record_id long, label string, y int, score double")
        with pytest.raises(Exception, match="score is undefined"):
            inference.bootstrap_counts(rows, ["grp"], 3, cuts=cuts).collect()


def test_replicates_match_resampled_rows(spark, preds):
    pdf = seeded()
    one = pdf[(pdf.run_id == "100-0") & (pdf.label == "a")]
    df = spark.createDataFrame(one)
    counts = {r["rep"]: r for r in inference.bootstrap_counts(df, ["run_id"], 5).collect()}
    w = inference.bootstrap_weights(df, 5).toPandas()
    for rep, part in w.groupby("rep"):
        rows = one.merge(part, on="record_id")
        rows = rows.loc[rows.index.repeat(rows.w)]
        p, n = rows[rows.y == 1].score.to_numpy(), rows[rows.y == 0].score.to_numpy()
        u2 = 2 * (p[:, None] > n[None, :]).sum() + (p[:, None] == n[None, :]).sum()
        assert (counts[rep]["n_pos"], counts[rep]["n_neg"], counts[rep]["u2"]) == (len(p), len(n), u2)


def test_interval_and_p_match_numpy_and_drop_undefined(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0.5, 1, 301)
    rows = [("x", float(x)) for x in v] + [("x", float("nan")), ("x", None)]
    got = inference.draw_summary(spark.createDataFrame(rows, "g string, value double"), ["g"]).first()
    lo, hi = np.percentile(v, [2.5, 97.5])
    assert (got["n_draws"], got["n_defined"]) == (303, 301)
    assert got["lo"] == pytest.approx(lo) and got["hi"] == pytest.approx(hi)
    le, ge = (v <= 0).sum() + 1, (v >= 0).sum() + 1
    assert got["p_raw"] == pytest.approx(min(1.0, 2 * min(le, ge) / 302))
    with pytest.raises(Exception, match="undefined"):
        inference.percentile_ci(spark.createDataFrame([("x", float("nan"))], "g string, value double"), ["g"]).collect()


# Published raw and adjusted p-values of two families of six.
PUBLISHED = {
    "macro_clean": [(0.819718, 1.0), (0.606739, 1.0), (0.029397, 0.146985), (0.325567, 0.976702), (0.008199, 0.049195), (0.031397, 0.146985)],
    "macro_all": [(0.387161, 0.852515), (0.083392, 0.416958), (0.672133, 0.852515), (0.192181, 0.768723), (0.284172, 0.852515), (0.025797, 0.154785)],
}


@pytest.mark.parametrize("cuts", [(), (0.03, 0.2, 0.5)])
def test_holm_reproduces_published_families(spark, cuts):
    rows = [(f, i, p, q) for f, ps in PUBLISHED.items() for i, (p, q) in enumerate(ps)]
    df = spark.createDataFrame(rows, "family string, i int, p_raw double, want double")
    for r in inference.holm(df, ["family"], cuts=cuts).collect():
        assert r["p_holm"] == pytest.approx(r["want"], abs=6e-6)


def test_holm_is_monotone_capped_and_tie_safe(spark):
    df = spark.createDataFrame([("f", p) for p in (0.001, 0.02, 0.02, 0.04, 0.6)], "family string, p_raw double")
    got = [r["p_holm"] for r in inference.holm(df, ["family"]).orderBy("p_raw").collect()]
    assert got == pytest.approx([0.005, 0.08, 0.08, 0.08, 0.6])


def test_comparison_properties(spark, frozen):
    pdf = seeded(same=("240", "500"), strength={"100": 900})
    out = {(r["endpoint"], r["a"], r["b"]): r for r in inference.compare_groups(spark.createDataFrame(pdf), frozen, N_BOOT).collect()}
    assert len(out) == 6
    for r in out.values():
        assert r["p_holm"] >= r["p_raw"]
        assert r["lo_simultaneous"] <= r["lo"] <= r["hi"] <= r["hi_simultaneous"]
    for endpoint in ("macro_all", "macro_clean"):
        null = out[endpoint, "240", "500"]
        assert (null["diff"], null["lo"], null["hi"], null["p_raw"]) == (0.0, 0.0, 0.0, 1.0) and null["crosses_zero"]
        assert not out[endpoint, "100", "240"]["crosses_zero"]


def test_duplicated_run_leaves_the_interval_unchanged(spark, frozen):
    pdf = seeded(groups=("100",), seeds=1)
    twice = pd.concat([pdf, pdf.assign(run_id="copy", seed=1)], ignore_index=True)
    a, z = (
        {r["endpoint"]: r for r in inference.seed_mean(spark.createDataFrame(p), frozen, N_BOOT).collect()} for p in (pdf, twice)
    )
    for k in a:
        assert [a[k][c] for c in ("point", "lo", "hi")] == pytest.approx([z[k][c] for c in ("point", "lo", "hi")], abs=1e-15)
        assert a[k]["seed_spread"] == z[k]["seed_spread"] == 0.0


def test_paired_and_single_metric_forms(spark):
    pdf = seeded(groups=("100", "500"), seeds=1, strength={"500": 900})
    df = spark.createDataFrame(pdf)
    r = inference.paired_bootstrap(df, inference.macro_auroc_metric, N_BOOT).first()
    assert r["diff"] < 0 and not r["crosses_zero"] and r["p_value"] == pytest.approx(2 / (N_BOOT + 1))
    for metric in (inference.macro_auprc_metric, inference.accuracy_metric):
        for r in inference.bootstrap_ci(df, metric, ["grp"], N_BOOT).collect():
            assert r["lo"] <= r["point"] <= r["hi"]


# --- null contrasts and verdicts ----------------------------------------------------------------

def test_subset_pairs():
    assert [len(decisions.half_subsets(n)[1]) for n in (1, 2, 3, 4, 5, 6)] == [0, 1, 3, 3, 15, 10]


def test_null_contrast_values(spark, preds, frozen):
    out = decisions.null_contrasts(preds, 5, frozen)
    assert {(r["grp"], r["endpoint"]): r["count"] for r in out.groupBy("grp", "endpoint").count().collect()} == {
        (g, e): 15 for g in ("100", "240", "500") for e in ("macro_all", "macro_clean")
    }
    same = preds.drop("score").join(preds.where("seed = 0").select("grp", "record_id", "label", "score"), ["grp", "record_id", "label"])
    zero = decisions.null_contrasts(same.where("seed < 4"), 4, frozen)
    assert zero.count() == 18 and zero.where("value <> 0").count() == 0
    assert decisions.null_contrasts(preds.where("seed = 0"), 1, frozen).count() == 0
    with pytest.raises(Exception, match="does not have 4 seeds"):
        decisions.null_contrasts(preds, 4, frozen).collect()


def verdict_of(spark, diff, lo, hi, null, spread=0.001):
    pairs = spark.createDataFrame(
        [("e", "x", "y", diff, lo, hi, lo, hi, 0.04), ("e", "x", "z", diff / 2, lo, hi, lo, hi, 0.04)],
        "endpoint string, a string, b string, diff double, lo double, hi double, lo_simultaneous double, hi_simultaneous double, p_holm double",
    )
    pooled = spark.createDataFrame([("e", null)], "endpoint string, null_median double")
    disp = spark.createDataFrame([("e", "x", spread, spread / 2, 5)], "endpoint string, grp string, seed_spread double, seed_std double, n_seeds int")
    return decisions.interpret_delta(pairs, pooled, disp).first()


def test_verdict_order(spark):
    cases = [
        ((0.05, -0.01, 0.1, 0.001), "not_detectable"),
        ((0.00008, 0.000002, 0.000162, 0.0008), "not_detectable"),  # excludes 0, but under the comparator
        ((-0.001514, -0.00265, -0.000425, 0.000772), "below_typical_gap"),
        ((0.01, 0.005, 0.015, 0.001), "comparable_to_reported_gaps"),
        ((0.025, 0.02, 0.03, 0.001), "exceeds_any_gap"),
    ]
    for args, want in cases:
        r = verdict_of(spark, *args)
        assert (r["verdict"], r["comparator"], r["b"]) == (want, "null_contrast", "y")
    r = verdict_of(spark, 0.025, 0.02, 0.03, None, spread=0.03)
    assert (r["verdict"], r["comparator"], r["comparator_value"]) == ("not_detectable", "seed_spread", 0.03)
    r = verdict_of(spark, 0.025, 0.02, 0.03, 0.01)
    assert r["null_contrast_matched"] == pytest.approx(0.01 * np.sqrt(0.4))


def test_gate(spark):
    df = spark.createDataFrame(
        [("a", 0.941, 0.935, 0.947), ("b", 0.9385, 0.937, 0.940), ("c", 0.920, 0.900, 0.950)], "k string, point double, lo double, hi double"
    )
    got = {r["k"]: (r["ci_contains_target"], r["point_within_tolerance"], r["accepted"]) for r in decisions.gate_verdict(df).collect()}
    assert got == {"a": (True, True, True), "b": (False, True, False), "c": (True, False, False)}


def test_negative_control_tag(spark):
    df = spark.createDataFrame([("240", "250"), ("100", "250")], "a string, b string")
    assert [r["negative_control"] for r in decisions.tag_negative_control(df).orderBy(F.desc("a")).collect()] == [True, False]


@pytest.mark.parametrize("cuts", [(), (0.015, 0.3)])
def test_holm_keeps_rows_without_a_p(spark, cuts):
    rows = [("f", 0.001), ("f", 0.02), ("f", 0.02), ("f", None), ("f", float("nan")), ("f", 0.6)]
    got = inference.holm(spark.createDataFrame(rows, "fam string, p_raw double"), ["fam"], cuts=cuts).collect()
    assert len(got) == 6 and [r["p_holm"] for r in got if r["p_raw"] is None or r["p_raw"] != r["p_raw"]] == [None, None]
    assert sorted(round(r["p_holm"], 6) for r in got if r["p_holm"] is not None) == [0.004, 0.06, 0.06, 0.6]
