import hashlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import experiments, files, records
from pulsegrid.sources import tables

NAMES = ["AFIB", "CD", "HYP", "MI", "NORM", "PVC", "STTC"]


@pytest.fixture(scope="module")
def recs(spark):
    rows = [
        (i, i, i % 10 + 1, "{'NORM': 100.0}" if i % 3 == 0 else "{'MI': 0.0, 'STTC': 50.0, 'ODD': 1.0}") for i in range(12)
    ]
    return records.with_codes(spark.createDataFrame(rows, "record_id long, patient_id long, fold int, scp_codes string"))


@pytest.fixture(scope="module")
def statements(spark):
    return spark.createDataFrame([(n, f"about {n}" if n != "CD" else None) for n in NAMES], "label string, description string")


def test_presence_counts_even_at_likelihood_zero(recs, statements):
    names = records.dictionary(statements)
    assert names == NAMES
    dense = {(r["record_id"], r["label"]): r["y"] for r in records.label_presence(recs, names).collect()}
    assert len(dense) == 12 * 7
    assert dense[1, "MI"] == 1 and dense[1, "NORM"] == 0 and dense[0, "NORM"] == 1
    assert records.label_positives(recs, statements).count() == sum(dense.values()) == 4 + 16
    assert records.unlabelled(recs, ["PVC", "NORM"]).count() == 8


def test_restricted_labels_keep_their_order(recs):
    got = records.label_presence(recs.where("record_id = 0"), ["STTC", "NORM"]).orderBy("ordinal").collect()
    assert [(r["label"], r["y"]) for r in got] == [("STTC", 0), ("NORM", 1)]


def test_dictionary_table_of_any_length(spark, recs, statements):
    """Names stay a table: far more than a list may hold, with repeats and a NULL."""
    many = statements.select("label").unionByName(spark.range(0, 20_000).select(F.concat(F.lit("L"), "id").alias("label")))
    many = many.unionByName(many.limit(50)).unionByName(spark.createDataFrame([(None,)], "label string"))
    dense = records.label_presence(recs.where("record_id < 2"), many)
    got = dense.agg(F.count(F.lit(1)), F.sum("y"), F.max("ordinal"), F.count_distinct("label")).first()
    assert tuple(got) == (2 * 20_007, 3, 20_006, 20_007)
    listed = records.label_presence(recs, NAMES).select("record_id", "ordinal", "label", "y")
    tabled = records.label_presence(recs, statements).select("record_id", "ordinal", "label", "y")
    assert sorted(listed.collect()) == sorted(tabled.collect())
    assert records.unlabelled(recs, statements.where("label in ('PVC', 'NORM')")).count() == 8
    assert records.unlabelled(recs, statements.limit(0)).count() == 12


def test_dictionary_limit(statements):
    with pytest.raises(ValueError, match="label_positives"):
        records.dictionary(statements, limit=3)


def test_splits_and_coverage(recs):
    got = {r["record_id"]: r["split"] for r in records.assign_splits(recs).collect()}
    assert got[0] == got[7] == "train" and got[8] == "val" and got[9] == "test"
    sizes = {r["split"]: (r["n_records"], r["covers_all"]) for r in records.split_coverage(recs).collect()}
    assert sizes == {"train": (10, True), "val": (1, True), "test": (1, True)}
    odd = recs.withColumn("fold", F.when(F.col("record_id") == 3, 11).otherwise(F.col("fold")))
    assert not records.split_coverage(odd).first()["covers_all"]


def test_leakage_is_refused_between_splits_only(recs):
    within = recs.withColumn("patient_id", F.col("record_id") % 4).where("fold <= 8")
    rows = {r["scope"]: r["n_entities"] for r in records.entity_leakage(within).collect()}
    assert rows == {"train/val": 0, "train/test": 0, "val/test": 0, "fold": 4}
    assert records.refuse_leakage(within).count() == within.count()
    with pytest.raises(ValueError, match="shared between train/test"):
        records.refuse_leakage(recs.withColumn("patient_id", F.lit(1)))


def test_support_and_frozen_set(spark, recs, statements):
    support = records.label_support(recs, statements, 1)
    got = {r["label"]: r for r in support.collect()}
    assert (got["NORM"]["n_total"], got["NORM"]["n_train"], got["NORM"]["n_test"]) == (4, 3, 1)
    assert (got["PVC"]["n_total"], got["CD"]["description"]) == (0, None)
    assert got["MI"]["prevalence_pct"] == pytest.approx(66.667)
    assert [r["label"] for r in records.rarest_labels(support, 2).collect()] == ["STTC", "PVC"]
    frozen = records.frozen_set(support, 1)
    row = frozen.first()
    assert (row["labels_clean"], row["n_labels_all"], row["n_labels_clean"]) == (["NORM"], 7, 1)
    assert [r["label"] for r in records.frozen_columns(frozen, statements).collect()] == ["NORM"]
    for bad, message in [
        (frozen.withColumn("n_labels_clean", F.lit(2)), "another number"),
        (frozen.withColumn("n_labels_all", F.lit(9)), "another dictionary size"),
        (frozen.withColumn("labels_clean", F.array(F.lit("XX"))), "absent"),
    ]:
        with pytest.raises(Exception, match=message):
            records.frozen_columns(bad, statements).collect()
    drift = records.frozen_drift(spark.createDataFrame([("PVC",)], "label string"), support.where("in_macro_clean"))
    assert {(r["label"], r["side"]) for r in drift.collect()} == {("PVC", "frozen_only"), ("NORM", "derived_only")}
    checks = {r["check_name"]: r["ok"] for r in records.label_checks(recs, statements, frozen, n_labels=7, n_clean=1, min_positives=1).collect()}
    assert all(checks.values()) and len(checks) == 6


def test_fold_table_skips_missing_age(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0, 40.0), (2, 1, 1, 1, None), (3, 2, 1, 1, 61.0), (4, 3, 9, 0, 50.0)],
        "record_id long, patient_id long, fold int, sex int, age double",
    )
    got = {r["fold"]: r for r in records.fold_table(df).collect()}
    assert (got[1]["records"], got[1]["patients"], got[1]["female_pct"], got[1]["age_median"]) == (3, 2, 66.7, 50.5)
    assert got[9]["split"] == "validation"


def test_hash_sample_is_stable(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    a = [r["k"] for r in records.hash_sample(df, "k", 50, 1).collect()]
    assert sorted(a) == sorted(r["k"] for r in records.hash_sample(df.repartition(11), "k", 50, 1).collect())
    assert len(set(a)) == 50 and a != [r["k"] for r in records.hash_sample(df, "k", 50, 2).collect()]


# --- files -----------------------------------------------------------------------------------------

def test_checksums_against_real_files(spark, tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    for name in ("a.txt", "sub/b.txt", "extra.txt"):
        (root / name).write_text(name)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = [
        f"{digest('a.txt').upper()}  a.txt", f"{digest('other')} *sub\\b.txt", "", "onlyonepart", f"{digest('x')}\t records100/x.dat",
    ]
    (tmp_path / "sums.txt").write_text("\n".join(lines))
    listed = files.parse_checksums(spark.read.text(str(tmp_path / "sums.txt")))
    assert {r["name"] for r in listed.collect()} == {"a.txt", "sub/b.txt", "records100/x.dat"}
    disk = files.file_digests(tables.read_files(spark, str(root))).withColumn("name", F.regexp_replace("name", ".*/data/", ""))
    got = {r["name"]: r["status"] for r in files.compare_files(listed, disk).collect()}
    assert got == {"a.txt": "verified", "sub/b.txt": "mismatched", "records100/x.dat": "missing", "extra.txt": "unexpected"}
    quick = {r["name"]: r["status"] for r in files.compare_files(listed, disk, skip_prefix="records100/").collect()}
    assert quick == {"a.txt": "verified", "sub/b.txt": "mismatched"}
    found = files.file_inventory(tables.list_files(spark, str(root)).select(F.regexp_replace("path", ".*/data", "data").alias("path")))
    assert {(r["dir"], r["ext"], r["n_files"]) for r in found.collect()} == {("data", "txt", 2), ("data/sub", "txt", 1)}


# --- scans --------------------------------------------------------------------------------------------

def test_record_scan_types_and_required_columns(spark, tmp_path):
    good = tmp_path / "db.csv"
    good.write_text(
        "ecg_id,patient_id,age,sex,scp_codes,strat_fold,filename_lr,filename_hr\n"
        "1,15709.0,56.0,1,\"{'NORM': 100.0, 'SR': 0.0}\",3,lo/1,hi/1\n2,13243.0,,0,\"{'MI': 0.0}\",10,lo/2,hi/2\n"
    )
    got = records.with_codes(tables.scan_records(spark, str(good))).orderBy("record_id").collect()
    assert (got[0]["patient_id"], got[0]["codes"], got[1]["age"]) == (15709, {"NORM": 100.0, "SR": 0.0}, None)
    bad = tmp_path / "bad.csv"
    bad.write_text("ecg_id,patient_id\n1,2\n")
    with pytest.raises(ValueError, match="strat_fold"):
        tables.scan_records(spark, str(bad))


def test_dictionary_scan_takes_the_first_column(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text(",description\nNORM,normal ECG\nMI,\n")
    assert {(r["label"], r["description"]) for r in tables.scan_labels(spark, str(p)).collect()} == {("NORM", "normal ECG"), ("MI", None)}


HEADER = "run_id,block,fs,arm,notch,source,seed,selection\n"


def matrix(tmp_path, spark):
    rows = [f"b0-fs100-A-n0-s{s},0,100,A,0,hr,{s},macro_all" for s in range(3)]
    rows += [f"b1-fs{fs}-A-n1-s{s},1,{fs},A,1,hr,{s},macro_clean" for fs in (100, 240, 250, 500) for s in range(5)]
    rows += [f"b2-fs{fs}-B-n1-s{s},2,{fs},B,1,hr,{s},macro_clean" for fs in (240, 250, 500) for s in range(5)]
    rows += [f"b{b}-fs100-A-n0-s{s},{b},100,A,0,{'hr' if b == 3 else 'lr'},{s},macro_clean" for b in (3, 4) for s in range(5)]
    p = tmp_path / "runs.csv"
    p.write_text(HEADER + "\n".join(rows) + "\n")
    return tables.load_runs(spark, str(p))


def test_run_matrix(spark, tmp_path):
    runs = matrix(tmp_path, spark).cache()
    assert {r["block"]: r["count"] for r in runs.groupBy("block").count().collect()} == {0: 3, 1: 20, 2: 15, 3: 5, 4: 5}
    dup = experiments.duplicate_configs(runs).collect()
    assert sorted(r["run_id"][:2] for r in dup) == ["b0"] * 3 + ["b3"] * 3 and {r["n_runs"] for r in dup} == {2}
    pairs = experiments.replicate_pairs(runs).collect()
    assert {(r["block_a"], r["block_b"]) for r in pairs} == {(0, 3)} and len(pairs) == 3
    with pytest.raises(Exception, match="repeats inside a block"):
        experiments.replicate_pairs(runs.union(runs)).collect()
    sizes = {(r["family"], r["grp"]): r["count"] for r in experiments.families(runs).groupBy("family", "grp").count().collect()}
    assert sizes == {
        **{("rates", g): 5 for g in ("100", "240", "250", "500")},
        **{(f"arms@{fs}", a): 5 for fs in (240, 250, 500) for a in "AB"},
        ("notch@100", "with"): 5, ("notch@100", "without"): 5, ("source@100", "resampled"): 5, ("source@100", "distributed"): 5,
    }
    declared = experiments.families(runs)
    some = runs.where("run_id <> 'b4-fs100-A-n0-s2'")
    done = {r["family"]: r["complete"] for r in experiments.family_completeness(declared, some).collect()}
    assert [f for f, ok in done.items() if not ok] == ["source@100"]
    with pytest.raises(ValueError, match="b4-fs100-A-n0-s2"):
        experiments.refuse_incomplete(declared, some)
    wrong = tmp_path / "wrong.csv"
    wrong.write_text(HEADER.replace("source", "origin"))
    with pytest.raises(ValueError, match="header"):
        tables.load_runs(spark, str(wrong))


def test_histories_selection_and_drift(spark, tmp_path):
    for run, clean in (("x", "0.70,0.72,0.88"), ("y", "nan,0.71,0.71")):
        (tmp_path / run).mkdir()
        values = zip((0.80, 0.91, 0.85), clean.split(","))
        text = "epoch,train_loss,macro_all,macro_clean\n" + "".join(f"{i},0.5,{a},{c}\n" for i, (a, c) in enumerate(values))
        (tmp_path / run / "history.csv").write_text(text)
    h = tables.scan_history(spark, str(tmp_path)).cache()
    best = {r["run_id"]: (r["best_macro_all"], r["best_macro_clean"]) for r in experiments.best_epochs(h).collect()}
    assert best == {"x": (1, 2), "y": (1, 1)}  # the first maximum wins, undefined loses
    sel = {r["run_id"]: r for r in experiments.epoch_selection(h, F.lit("macro_clean")).collect()}
    assert (sel["x"]["selected_epoch"], sel["x"]["criteria_agree"], sel["x"]["macro_all"]) == (2, False, 0.85)
    assert sel["y"]["criteria_agree"]
    pairs = spark.createDataFrame([("x", "y")], "run_a string, run_b string")
    d = experiments.replicate_drift(h, pairs).first()
    assert (d["n_epochs"], d["max_train_loss"], d["exact_macro_all"]) == (3, 0.0, 3) and d["max_macro_clean"] == pytest.approx(0.17)


def test_prediction_alignment(spark, tmp_path):
    base = [(r, i, lab, i % 2, 0.1 * i) for r in ("a", "b") for i in range(4) for lab in ("p", "q")]
    cols = "run_id string, record_id int, label string, y int, score double"
    good = spark.createDataFrame(base, cols)
    tables.write_predictions(good, str(tmp_path / "p"))
    back = tables.scan_predictions(spark, str(tmp_path / "p"), ["a", "b"])
    frozen = spark.createDataFrame([("a", "p"), ("b", "p")], "run_id string, label string")
    assert experiments.refuse_misaligned(back, frozen).count() == 16
    cases = [
        (good.where("not (run_id = 'b' and record_id = 2)"), None, "not aligned"),
        (good.withColumn("y", F.when(F.expr("run_id = 'b' and record_id = 2"), 1).otherwise(F.col("y"))), None, "not aligned"),
        (good.union(good.limit(1)), None, "duplicate"),
        (good, frozen.union(spark.createDataFrame([("b", "q")], "run_id string, label string")), "different frozen"),
    ]
    for df, fr, message in cases:
        with pytest.raises(ValueError, match=message):
            experiments.refuse_misaligned(df, fr)


def test_fingerprints(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "record_id")
    fp = lambda d: experiments.record_fingerprint(d).first()["fingerprint"]
    assert fp(df) == fp(df.repartition(5).orderBy(F.desc("record_id"))) and len(fp(df)) == 16
    assert len({fp(df), fp(df.where("record_id <> 7")), fp(df.withColumn("record_id", F.col("record_id") + 1))}) == 3
    runs = spark.createDataFrame([("r", 1, 0.1)], "run_id string, seed int, lr double")
    one = lambda d: experiments.config_fingerprint(d, ["run_id", "seed", "lr"]).first()["fingerprint"]
    assert one(runs) == one(runs.select("lr", "seed", "run_id").withColumn("epochs", F.lit(5)))
    assert one(runs) != one(runs.withColumn("seed", F.lit(2)))
