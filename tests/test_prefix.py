import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import prefix


def frame(spark, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    # a third of the rows share one value and two thirds one group
    v = np.where(rng.random(n) < 0.33, 0.5, rng.normal(size=n).round(3))
    g = np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "c": rng.integers(0, 5, n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_small_inputs_get_no_cuts(spark):
    _, df = frame(spark)
    assert prefix.range_cuts(df, "v") == ()


def test_cuts_balance_distinct_values(spark):
    df = spark.range(0, 200_000).selectExpr("cast(id as double) * id as v")
    cuts = prefix.range_cuts(df, "v", rows_per_range=20_000)
    assert 8 <= len(cuts) <= 11 and list(cuts) == sorted(set(cuts))
    sizes = [r["count"] for r in prefix.with_range(df, "v", cuts).groupBy("_range").count().collect()]
    assert max(sizes) < 3 * 200_000 / len(sizes)


@pytest.mark.parametrize("cuts", [(), (-0.5, 0.2, 0.5, 1.0)])
@pytest.mark.parametrize("descending", [False, True])
def test_running_matches_one_window(spark, cuts, descending):
    pdf, df = frame(spark)
    flat = pdf.groupby(["g", "v"], as_index=False)["c"].sum()
    out = prefix.running(spark.createDataFrame(flat), ["g"], "v", ["c"], cuts, descending=descending, totals=True).toPandas()
    want = flat.sort_values("v", ascending=not descending)
    want["before_c"] = want.groupby("g")["c"].cumsum() - want["c"]
    want["all_c"] = want.groupby("g")["c"].transform("sum")
    cols = ["g", "v", "c", "before_c", "all_c"]
    key = ["g", "v"]
    pd.testing.assert_frame_equal(
        out[cols].sort_values(key).reset_index(drop=True), want[cols].sort_values(key).reset_index(drop=True), check_dtype=False
    )


def test_running_puts_null_first_and_nan_last_with_and_without_cuts(spark):
    df = spark.createDataFrame([("g", v, 1) for v in (None, float("nan"), 0.1, 0.4, 0.7)], "g string, v double, c int")
    for descending in (False, True):
        whole, parts = ({str(r["v"]): r["before_c"] for r in prefix.running(df, ["g"], "v", ["c"], cuts, descending=descending).collect()} for cuts in ((), (0.2, 0.5)))
        assert whole == parts and (whole["nan"], whole["None"]) == ((0, 4) if descending else (4, 0))


@pytest.mark.parametrize("cuts", [(), (300.0, 301.0, 2500.0)])
def test_dense_index_is_the_rank_of_the_key(spark, cuts):
    ids = spark.range(0, 3000).selectExpr("id * 3 as k").where("k % 7 != 0")
    out = prefix.dense_index(ids, "k", cuts=cuts).toPandas().sort_values("k")
    assert out["idx"].tolist() == list(range(len(out)))


@pytest.mark.parametrize("cuts", [(), (-1.0, 0.0, 0.5, 0.7)])
def test_exact_quantiles_match_numpy(spark, cuts):
    pdf, df = frame(spark)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in prefix.exact_quantiles(df, ["g"], "v", probs, cuts).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)
    whole = {r["p"]: r["q"] for r in prefix.exact_quantiles(df, [], "v", probs, cuts).collect()}
    for p in probs:
        assert whole[p] == pytest.approx(np.quantile(pdf["v"], p), abs=1e-12)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_lookup_join_keeps_every_row(spark, hot_rows):
    pdf, df = frame(spark)
    counts = df.groupBy("g").count().withColumnRenamed("count", "n")
    out = prefix.lookup_join(df, counts, ["g"], "n", hot_rows=hot_rows, salts=5).toPandas()
    assert len(out) == len(pdf)
    assert (out["n"] == out.groupby("g")["id"].transform("count")).all()


@pytest.mark.parametrize("cuts", [(), (0.0, 0.5)])
def test_running_max(spark, cuts):
    pdf, _ = frame(spark)
    flat = pdf.groupby(["g", "v"], as_index=False)["c"].sum()
    out = prefix.running_max(spark.createDataFrame(flat), ["g"], "v", "c", cuts).toPandas().sort_values(["g", "v"])
    want = flat.sort_values(["g", "v"]).groupby("g")["c"].cummax()
    assert out["top"].tolist() == want.tolist()
