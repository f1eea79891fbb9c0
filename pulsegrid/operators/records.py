"""Record metadata: code maps, presence labels, splits, support, frozen label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import require
from .prefix import exact_quantiles

# Fold ranges of the three splits and the support threshold.
TRAIN_FOLDS = (1, 8)
VAL_FOLD = 9
TEST_FOLD = 10
MIN_TEST_POSITIVES = 10

#: Names that :func:`dictionary` hands to the driver as a list; a table of names has no such limit.
MAX_DICTIONARY = 10_000


def parse_code_map(text: Column) -> Column:
    """``{'NORM': 100.0}`` as a map; the text is a Python literal, hence the quotes."""
    return F.from_json(text, "map<string,double>", {"allowSingleQuotes": "true"})


def with_codes(records: DataFrame, column: str = "scp_codes") -> DataFrame:
    return records.withColumn("codes", parse_code_map(F.col(column))).drop(column)


def code_rows(records: DataFrame) -> DataFrame:
    """One row per record and code; likelihood 0 means unknown, not absent."""
    keep = [c for c in records.columns if c != "codes"]
    return records.select(*keep, F.explode("codes").alias("code", "likelihood"))


def dictionary(statements: DataFrame, labels: Sequence[str] | None = None, limit: int = MAX_DICTIONARY) -> list[str]:
    """Label names as a list, for few of them; refuses more than ``limit``, which stay a table."""
    if labels is not None:
        return list(labels)
    names = [r[0] for r in statements.select("label").distinct().take(limit + 1)]
    if len(names) > limit:
        raise ValueError(f"more than {limit} labels: use label_positives, which stays sparse")
    return sorted(names)


def _named(records: DataFrame, labels: DataFrame | Sequence[str]) -> DataFrame:
    """The records with the label names as one array column ``_names``.

    A table of names of any length becomes one row, sorted, that joins every record;
    a list keeps its order.
    """
    if not isinstance(labels, DataFrame):
        return records.withColumn("_names", F.array(*[F.lit(n) for n in labels]).cast("array<string>"))
    names = labels.where("label is not null").agg(F.sort_array(F.collect_set("label")).alias("_names"))
    return records.crossJoin(F.broadcast(names))  # one row, always


def label_presence(records: DataFrame, labels: DataFrame | Sequence[str]) -> DataFrame:
    """Dense ``(record_id, label, y)``: absent labels are explicit zeros.

    ``labels`` is a table with a column ``label`` or a list of names; ordinals follow
    its sorted names or the list.  Presence is a key test on the record's own map, so
    no record is shuffled; unknown codes drop out.
    """
    keep = [c for c in records.columns if c != "codes"]
    return _named(records, labels).select(*keep, "codes", F.posexplode("_names").alias("ordinal", "label")).select(
        *keep, "ordinal", "label", F.map_contains_key("codes", F.col("label")).cast("int").alias("y")
    )


def label_positives(records: DataFrame, statements: DataFrame) -> DataFrame:
    """Sparse form: only ``(record, label)`` pairs that are present and known."""
    keep = [c for c in records.columns if c != "codes"]
    pairs = records.select(*keep, F.explode(F.map_keys("codes")).alias("label"))
    return pairs.join(statements.select("label").distinct(), "label", "left_semi")


def unlabelled(records: DataFrame, labels: DataFrame | Sequence[str]) -> DataFrame:
    """Records that carry no known label."""
    none = ~F.coalesce(F.arrays_overlap(F.map_keys("codes"), F.col("_names")), F.lit(False))
    return _named(records, labels).where(none).drop("_names")


def split_of(fold: str = "fold") -> Column:
    f = F.col(fold)
    return (
        F.when(f.between(*TRAIN_FOLDS), F.lit("train"))
        .when(f == VAL_FOLD, F.lit("val"))
        .when(f == TEST_FOLD, F.lit("test"))
    )


def assign_splits(records: DataFrame, fold: str = "fold") -> DataFrame:
    return records.withColumn("split", split_of(fold))


def entity_leakage(records: DataFrame) -> DataFrame:
    """Entities shared between two splits, and entities in more than one fold.

    Flags and fold extremes per entity combine on the map side, so a hot entity
    sends a few rows however many records it has.
    """
    has = lambda s: F.max(F.when(split_of() == s, 1).otherwise(0))
    per = records.groupBy("patient_id").agg(
        has("train").alias("train"), has("val").alias("val"), has("test").alias("test"),
        F.min("fold").alias("low"), F.max("fold").alias("high"),
    )
    checks = {
        "train/val": (F.col("train") + F.col("val")) == 2,
        "train/test": (F.col("train") + F.col("test")) == 2,
        "val/test": (F.col("val") + F.col("test")) == 2,
        "fold": F.col("low") < F.col("high"),
    }
    cols = []
    for i, cond in enumerate(checks.values()):
        cols += [F.count(F.when(cond, 1)).alias(f"n{i}"), F.min(F.when(cond, F.col("patient_id"))).alias(f"f{i}")]
    rows = F.array(*[
        F.struct(F.lit(name).alias("scope"), F.col(f"n{i}").alias("n_entities"), F.col(f"f{i}").alias("first_entity"))
        for i, name in enumerate(checks)
    ])
    return per.agg(*cols).select(F.inline(rows))


def refuse_leakage(records: DataFrame) -> DataFrame:
    """The records with their split; fails if two splits share an entity."""
    shared = entity_leakage(records).where((F.col("scope") != "fold") & (F.col("n_entities") > 0)).collect()
    if shared:
        raise ValueError("; ".join(f"{r['n_entities']} entities shared between {r['scope']}" for r in shared))
    return assign_splits(records)


def split_coverage(records: DataFrame) -> DataFrame:
    """Size of each split, and whether the splits add up to all records."""
    sizes = records.agg(
        *[F.count(F.when(split_of() == s, 1)).alias(s) for s in ("train", "val", "test")],
        F.count(F.lit(1)).alias("total"),
    )
    rows = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n_records")) for s in ("train", "val", "test")])
    covered = (F.col("train") + F.col("val") + F.col("test")) == F.col("total")
    return sizes.select(F.inline(rows), "total", covered.alias("covers_all"))


def fold_table(records: DataFrame, cuts: Sequence[float] | None = None) -> DataFrame:
    """Per fold: records, entities, share of women, exact median age (missing skipped)."""
    base = records.groupBy("fold").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("patient_id").alias("patients"),
        F.bround(100 * F.avg("sex"), 1).alias("female_pct"),
    )
    age = exact_quantiles(records, ["fold"], "age", [0.5], cuts).select("fold", F.col("q").alias("age_median"))
    name = F.when(split_of() == "val", F.lit("validation")).otherwise(split_of())
    return base.join(age, "fold", "left").select(
        "fold", name.alias("split"), "records", "patients", "female_pct", "age_median"
    )


def dataset_counts(records: DataFrame, expected_records: int | None = None, expected_patients: int | None = None) -> DataFrame:
    counted = records.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("patient_id").alias("n_patients"))
    same = lambda c, v: F.lit(None).cast("boolean") if v is None else F.col(c) == v
    return counted.select(
        "n_records", "n_patients",
        same("n_records", expected_records).alias("records_ok"),
        same("n_patients", expected_patients).alias("patients_ok"),
    )


def label_support(
    records: DataFrame, statements: DataFrame, min_positives: int = MIN_TEST_POSITIVES
) -> DataFrame:
    """Support of every dictionary label; labels never seen count 0.

    Works on the codes present, so the record × label matrix is never built.
    """
    n = records.agg(F.count(F.lit(1)).alias("n_records"))
    seen = records.select("fold", F.explode(F.map_keys("codes")).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(F.when(F.col("fold").between(*TRAIN_FOLDS), 1)).alias("n_train"),
        F.count(F.when(F.col("fold") == TEST_FOLD, 1)).alias("n_test"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (
        statements.join(seen, "label", "left")
        .select("label", "description", zero("n_total"), zero("n_train"), zero("n_test"))
        .join(F.broadcast(n))  # one row
        .select(
            "label", "description", "n_total", "n_train", "n_test",
            F.bround(100 * F.col("n_total") / F.col("n_records"), 3).alias("prevalence_pct"),
            (F.col("n_test") >= min_positives).alias("in_macro_clean"),
        )
    )


def rarest_labels(support: DataFrame, n: int = 8) -> DataFrame:
    """The report's tail: the ``n`` labels with the least test support."""
    return support.orderBy("n_test", F.col("label").desc()).limit(n)


def frozen_set(support: DataFrame, min_positives: int = MIN_TEST_POSITIVES) -> DataFrame:
    """One row that freezes the labels with enough test support (a list of names)."""
    kept = F.sort_array(F.collect_list(F.when(F.col("in_macro_clean"), F.col("label"))))
    return support.agg(
        F.lit(min_positives).alias("min_test_positives"),
        F.lit(TEST_FOLD).alias("test_fold"),
        F.count(F.lit(1)).alias("n_labels_all"),
        F.count(F.when(F.col("in_macro_clean"), 1)).alias("n_labels_clean"),
        kept.alias("labels_clean"),
    )


def frozen_columns(frozen: DataFrame, statements: DataFrame) -> DataFrame:
    """Frozen labels in their stored order; an inconsistent set makes the query fail."""
    known = statements.agg(
        F.count_distinct("label").alias("n_known"), F.collect_set("label").alias("known")
    )
    one = frozen.join(F.broadcast(known))  # one row each
    absent = F.array_except("labels_clean", "known")
    checked = require(
        F.size("labels_clean") == F.col("n_labels_clean"), "the frozen set lists another number of labels",
        require(
            F.col("n_known") == F.col("n_labels_all"), "the frozen set assumes another dictionary size",
            require(F.size(absent) == 0, "frozen labels absent from the dictionary", F.col("labels_clean")),
        ),
    )
    return one.select(F.posexplode(checked).alias("ordinal", "label"))


def frozen_drift(frozen: DataFrame, derived: DataFrame) -> DataFrame:
    """Labels only in the frozen set, and labels only in the recomputed one."""
    a, b = frozen.select("label"), derived.select("label")
    return a.exceptAll(b).withColumn("side", F.lit("frozen_only")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("derived_only"))
    )


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement in md5 order of ``seed:key``: repeatable anywhere.

    A sampling operator, so the limit is the feature; it runs as a top-k.
    """
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("_h", rank).orderBy("_h", key).limit(n).drop("_h")


# --- reports ---------------------------------------------------------------------------

CHECK_SCHEMA = "check_name string, ok boolean, detail string"


def check_rows(one_row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Turn a one-row aggregate into ``(check_name, ok, detail)`` rows."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), ok.alias("ok"), detail.cast("string").alias("detail"))
        for name, (ok, detail) in checks.items()
    ])
    return one_row.select(F.inline(rows))


def integrity_report(
    records: DataFrame, disk: DataFrame, expected_records: int, expected_patients: int, key: str = "record_id"
) -> DataFrame:
    """Counts against expectation, referenced files present, entities in one fold."""
    counts = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("p"))
    absent = records.select(key).join(disk.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    leaks = records.groupBy("patient_id").agg((F.min("fold") < F.max("fold")).alias("several")).agg(
        F.count(F.when(F.col("several"), 1)).alias("leaks")
    )
    one = counts.join(F.broadcast(absent)).join(F.broadcast(leaks))  # three one-row tables
    return check_rows(one, {
        "record_count": (F.col("n") == expected_records, F.col("n")),
        "patient_count": (F.col("p") == expected_patients, F.col("p")),
        "files_present": (F.col("missing") == 0, F.col("missing")),
        "patients_in_one_fold": (F.col("leaks") == 0, F.col("leaks")),
    })


def label_checks(
    records: DataFrame, statements: DataFrame, frozen: DataFrame, *, n_labels: int, n_clean: int,
    min_positives: int = MIN_TEST_POSITIVES,
) -> DataFrame:
    """Dictionary size, labelled records, support and agreement with the frozen set."""
    support = label_support(records, statements, min_positives)
    sizes = support.agg(
        F.count(F.lit(1)).alias("labels"), F.count(F.when(F.col("in_macro_clean"), 1)).alias("clean"),
        F.sort_array(F.collect_list(F.when(F.col("in_macro_clean"), F.col("label")))).alias("derived"),
    )
    bare = unlabelled(records, statements).agg(F.count(F.lit(1)).alias("bare"))
    one = sizes.join(F.broadcast(bare)).join(F.broadcast(frozen))  # one row each
    return check_rows(one, {
        "dictionary_size": (F.col("labels") == n_labels, F.col("labels")),
        "every_record_labelled": (F.col("bare") == 0, F.col("bare")),
        "clean_labels": (F.col("clean") == n_clean, F.col("clean")),
        "frozen_threshold": (F.col("min_test_positives") == min_positives, F.col("min_test_positives")),
        "frozen_test_fold": (F.col("test_fold") == TEST_FOLD, F.col("test_fold")),
        "frozen_equals_derived": (
            F.sort_array("labels_clean") == F.col("derived"), F.array_join("derived", ",")
        ),
    })
