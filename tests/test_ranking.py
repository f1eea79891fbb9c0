import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ranking


def brute_auroc(y, s, w=None):
    w = np.ones(len(y), dtype=int) if w is None else w
    p, n = y > 0, y <= 0
    if w[p].sum() == 0 or w[n].sum() == 0:
        return None
    above = (s[p][:, None] > s[n][None, :]) + 0.5 * (s[p][:, None] == s[n][None, :])
    return float((above * w[p][:, None] * w[n][None, :]).sum() / (w[p].sum() * w[n].sum()))


def brute_ap(y, s):
    if y.min() == y.max():
        return None
    total, last = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        chosen = s >= t
        recall = y[chosen].sum() / y.sum()
        total += (recall - last) * y[chosen].mean()
        last = recall
    return total


def predictions(seed=0, n=150, labels=4, runs=2, levels=12):
    rng = np.random.default_rng(seed)
    rows = []
    for j in range(labels):
        y = (rng.random(n) < 0.1 + 0.2 * j).astype(int)
        if j == 3:
            y[:] = 0  # undefined
        for r in range(runs):
            s = np.floor((y * 0.3 + rng.random(n)) * levels) / levels
            rows.append(pd.DataFrame({"run_id": f"r{r}", "record_id": np.arange(n), "label": f"l{j}", "y": y, "score": s}))
    return pd.concat(rows, ignore_index=True)


def test_hand_cases(spark):
    rows = [("a", y, s) for y, s in [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]]
    rows += [("perfect", y, float(y)) for y in (0, 0, 1)] + [("inverted", y, -float(y)) for y in (0, 0, 1)]
    rows += [("tied", y, 1.0) for y in (0, 1, 1)] + [("zeros", 0, 0.1), ("ones", 1, 0.2), ("ones", 1, 0.3)]
    df = spark.createDataFrame(rows, "label string, y int, score double")
    got = {r["label"]: r for r in ranking.label_scores(df, ["label"]).collect()}
    assert got["a"]["auroc"] == 0.75
    assert (got["perfect"]["auroc"], got["inverted"]["auroc"], got["tied"]["auroc"]) == (1.0, 0.0, 0.5)
    for name in ("zeros", "ones"):
        assert got[name]["auroc"] is None and got[name]["auprc"] is None
    assert [got[k]["n_pos"] for k in ("zeros", "ones")] == [0, 2]
    part = spark.createDataFrame(got.values()).where("label in ('a', 'tied', 'zeros', 'ones')").selectExpr("'r' run_id", "*")
    assert ranking.defined_fraction(part, ["run_id"]).first()["defined_fraction"] == 0.5
    assert ranking.macro(part, ["run_id"]).first()["macro_all"] == pytest.approx(0.625)


@pytest.mark.parametrize("cuts", [(), (0.2, 0.5, 0.9)])
def test_scores_match_pairwise_definition(spark, cuts):
    pdf = predictions()
    df = spark.createDataFrame(pdf).repartition(5)
    forms = [ranking.auroc(df, cuts=cuts), ranking.auroc(df, cuts=cuts, combine=False), ranking.auroc(df), ranking.label_scores(df, cuts=cuts)]
    for got in (f.collect() for f in forms):
        assert len(got) == 8
        for r in got:
            part = pdf[(pdf.run_id == r["run_id"]) & (pdf.label == r["label"])]
            want = brute_auroc(part.y.to_numpy(), part.score.to_numpy())
            assert r["auroc"] == (None if want is None else pytest.approx(want, abs=1e-12))
            if "auprc" in r:
                want = brute_ap(part.y.to_numpy(), part.score.to_numpy())
                assert r["auprc"] == (None if want is None else pytest.approx(want, abs=1e-12))


@pytest.mark.parametrize("cuts", [(), (0.2, 0.5, 0.9)])
def test_weights_equal_repeated_rows(spark, cuts):
    pdf = predictions(1)
    pdf["w"] = np.random.default_rng(2).integers(0, 4, len(pdf))
    repeated = pdf.loc[pdf.index.repeat(pdf.w)]
    one = ranking.pair_counts(spark.createDataFrame(pdf), weight="w", cuts=cuts, combine=False).orderBy("run_id", "label").collect()
    two = ranking.pair_counts(spark.createDataFrame(pdf), weight="w", cuts=cuts, combine=True).orderBy("run_id", "label").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two]
    a = ranking.label_scores(spark.createDataFrame(pdf), weight="w", cuts=cuts).orderBy("run_id", "label").collect()
    z = ranking.label_scores(spark.createDataFrame(repeated), cuts=()).orderBy("run_id", "label").collect()
    for x, y in zip(a, z):
        assert (x["n_pos"], x["n_neg"]) == (y["n_pos"], y["n_neg"])
        assert x["auroc"] == y["auroc"]
        assert x["auprc"] == (None if y["auprc"] is None else pytest.approx(y["auprc"], abs=1e-12))


@pytest.mark.parametrize("cuts", [(), (0.2, 0.5)])
def test_midranks(spark, cuts):
    pdf = predictions(3)
    out = ranking.midranks(spark.createDataFrame(pdf), ["run_id", "label"], cuts=cuts).toPandas()
    want = pdf.set_index(["run_id", "label", "record_id"]).groupby(["run_id", "label"])["score"].rank()
    got = out.set_index(["run_id", "label", "record_id"])["midrank"]
    assert len(got) == len(want) and (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("cuts", [(), (0.2, 0.5)])
def test_undefined_scores_with_and_without_cuts(spark, cuts):
    nan = float("nan")
    rows = [("a", 1, 0.1), ("a", 0, 0.4), ("a", 1, 0.4), ("a", 0, None), ("a", 1, None), ("a", 1, nan), ("a", 0, nan), ("a", 0, 0.9), ("b", 1, None), ("c", 0, nan)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, label string, y int, score double")
    got = {r["id"]: r["midrank"] for r in ranking.midranks(df, ["label"], cuts=cuts).collect()}
    assert got == {0: 1.0, 1: 2.5, 2: 2.5, 3: None, 4: None, 5: None, 6: None, 7: 4.0, 8: None, 9: None}
    for bad in (df.where("score is null or score < 1"), df.where("isnan(score) or score < 1")):
        for form in (lambda d: ranking.auroc(d, ["label"], cuts=cuts), lambda d: ranking.auroc(d, ["label"], cuts=cuts, combine=False), lambda d: ranking.label_scores(d, ["label"], cuts=cuts)):
            with pytest.raises(Exception, match="a score is undefined"):
                form(bad).collect()


def test_wide_and_narrow_pair_counts_agree(spark, monkeypatch):
    df = spark.createDataFrame(predictions(5))
    narrow = ranking.label_scores(df, cuts=(0.4,)).orderBy("run_id", "label").collect()
    monkeypatch.setattr(ranking, "BIGINT_RANGES", 0)
    assert ranking.label_scores(df, cuts=(0.4,)).orderBy("run_id", "label").collect() == narrow


def test_hot_score_and_hot_label(spark):
    # a third of the rows carry one score, all in one label
    df = spark.range(0, 60_000).selectExpr(
        "'r' run_id", "case when id % 3 = 0 then 'hot' else concat('l', id % 7) end label",
        "case when id % 3 = 0 then 0.0 else (id * 7919 % 1000) / 1000 end score", "cast(id % 5 = 0 as int) y",
    )
    one = {r["label"]: r["auroc"] for r in ranking.auroc(df, cuts=()).collect()}
    cut = {r["label"]: r["auroc"] for r in ranking.auroc(df, cuts=(0.0, 0.25, 0.5)).collect()}
    assert one == cut and one["hot"] == 0.5


def test_crop_mean_averages_probabilities_and_refuses_ragged(spark):
    rows = [("r", i // 4, "l", (i // 4) % 2, float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id string, record_id int, label string, y int, score double")
    assert [r["score"] for r in ranking.crop_mean(df).orderBy("record_id").collect()] == [1.5, 5.5]
    with pytest.raises(Exception, match="crop count"):
        ranking.crop_mean(df.where("score < 7")).collect()
    with pytest.raises(Exception, match="label changes"):
        ranking.crop_mean(df.selectExpr("run_id", "record_id", "label", "cast(score % 2 as int) y", "score")).collect()


def test_seed_dispersion_of_one_seed_is_zero(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("b", 0.9)], "grp string, macro_all double")
    got = {r["grp"]: r for r in ranking.seed_dispersion(df).collect()}
    assert (got["a"]["seed_spread"], got["a"]["seed_std"]) == (0.0, 0.0)
    assert got["b"]["seed_spread"] == pytest.approx(0.1) and got["b"]["seed_std"] == pytest.approx(np.std([0.8, 0.9], ddof=1))


def test_accuracy(spark):
    df = spark.createDataFrame([("r", "l", 1, 0.7), ("r", "l", 0, 0.6), ("r", "l", 0, 0.1)], "run_id string, label string, y int, score double")
    assert ranking.accuracy_at(df).first()["accuracy"] == pytest.approx(2 / 3)


def test_totals_of_an_unpivot_are_made_once(spark):
    """No exchange above an unpivot is reused, so the scan reads totals that are written."""
    pdf = predictions(labels=2, runs=1)
    wide = pdf.pivot_table(index="record_id", columns="label", values=["y", "score"])
    wide.columns = [f"{a}_{b}" for a, b in wide.columns]
    wide = spark.createDataFrame(wide).withColumns({c: F.col(c).cast("int") for c in ("y_l0", "y_l1")})
    scores, labels = ["score_l0", "score_l1"], ["y_l0", "y_l1"]
    long = wide.unpivot(labels, scores, "run_id", "score").unpivot(["run_id", "score"], labels, "label", "y")
    want = sorted(map(tuple, ranking.label_scores(long, cuts=()).collect()))
    assert len(want) == 4
    for cuts in (None, (0.3, 0.8)):
        got = ranking.label_scores(long, cuts=cuts)
        assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
        both = ranking.scores_of_counts(ranking.collapse_wide(wide, scores, labels), cuts=cuts)
        for df in (got, both):
            assert [tuple(map(pytest.approx, r)) for r in sorted(map(tuple, df.collect()))] == want
    with pytest.raises(Exception, match="a score is undefined"):
        ranking.scores_of_counts(ranking.collapse_wide(wide.withColumn("score_l0", F.lit(None).cast("double")), scores, labels)).collect()


@pytest.mark.parametrize("cuts", [None, (0.5,)])
def test_pairs_of_few_scores_and_many_cells(spark, cuts):
    """Few distinct scores are few ranges, but their pairs need not fit a BIGINT."""
    rows = [(s, y, 4_000_000_000 + y) for s in (0.2, 0.8) for y in (0, 1)]
    df = spark.createDataFrame(rows, "score double, y int, w long").withColumn("label", F.lit("a"))
    got = ranking.label_scores(df, ["label"], "w", cuts).first()
    assert (got["n_pos"], got["n_neg"], got["auroc"]) == (8_000_000_002, 8_000_000_000, 0.5)
