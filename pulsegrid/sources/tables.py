"""Scans and sinks of the study's files; every scan has a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Column names of the file formats.
RECORD_COLUMNS = {
    "ecg_id": "bigint", "patient_id": "bigint", "sex": "int", "age": "double", "strat_fold": "int",
    "scp_codes": "string", "filename_lr": "string", "filename_hr": "string",
}
REQUIRED_RECORD_COLUMNS = ("ecg_id", "patient_id", "strat_fold", "scp_codes", "filename_lr", "filename_hr")
RUN_COLUMNS = {
    "run_id": "string", "block": "int", "fs": "int", "arm": "string", "notch": "int", "source": "string",
    "seed": "bigint", "selection": "string",
}
HISTORY_COLUMNS = {"epoch": "int", "train_loss": "double", "macro_all": "double", "macro_clean": "double"}
FROZEN_SCHEMA = T.StructType([
    T.StructField("min_test_positives", T.IntegerType()),
    T.StructField("test_fold", T.IntegerType()),
    T.StructField("n_labels_all", T.LongType()),
    T.StructField("n_labels_clean", T.LongType()),
    T.StructField("labels_clean", T.ArrayType(T.StringType())),
])
SCALER_SCHEMA = (
    "version int, fs int, notch boolean, source string, window string, folds string, "
    "record_fingerprint string, n_values bigint, mean double, std double"
)
SELECTION_SCHEMA = (
    "run_id string, selection string, selected_epoch int, "
    "best_epoch_per_metric struct<macro_all:int,macro_clean:int>, criteria_agree boolean, "
    "value_at_selected_epoch struct<macro_all:double,macro_clean:double>"
)
SCALER_VERSION = 1


def _csv(spark: SparkSession, path) -> DataFrame:
    # only the header line decides the names; nothing is inferred from data
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _typed(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    # missing numbers are written empty or as nan; both become NULL
    def value(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "int", "bigint"):
            c = F.when(~F.lower(F.trim(c)).isin("", "nan"), c)
        if kind in ("int", "bigint"):
            c = c.cast("double")
        return c.cast(kind).alias(name)

    return raw.select(*[value(n, k) for n, k in columns.items() if n in raw.columns])


def scan_records(spark: SparkSession, path) -> DataFrame:
    """Record metadata; an absent required column is an error."""
    raw = _csv(spark, path)
    absent = sorted(set(REQUIRED_RECORD_COLUMNS) - set(raw.columns))
    if absent:
        raise ValueError(f"columns absent from the record metadata: {absent}")
    return _typed(raw, RECORD_COLUMNS).withColumnsRenamed({"ecg_id": "record_id", "strat_fold": "fold"})


def write_records(records: DataFrame, path: str) -> None:
    records.withColumnsRenamed({"record_id": "ecg_id", "fold": "strat_fold"}).write.option("header", True).option(
        "quote", '"'
    ).option("escape", '"').csv(path)


def scan_labels(spark: SparkSession, path) -> DataFrame:
    """Label dictionary: the first column holds the names, whatever its title."""
    raw = _csv(spark, path)
    description = F.col("description") if "description" in raw.columns else F.lit(None).cast("string")
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("label"), description.alias("description"))


def load_runs(spark: SparkSession, path) -> DataFrame:
    """Run matrix with an exact header; 0/1 becomes a boolean."""
    raw = _csv(spark, path)
    if tuple(raw.columns) != tuple(RUN_COLUMNS):
        raise ValueError(f"unexpected run matrix header: {raw.columns}")
    return _typed(raw, RUN_COLUMNS).withColumn("notch", F.col("notch") == 1)


def _run_of_path() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)


def scan_history(spark: SparkSession, path) -> DataFrame:
    """Epoch histories of many run folders; the folder names the run.

    A key=value folder name counts by its value.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    run = F.regexp_replace(_run_of_path(), "^run_id=", "")
    return _typed(raw.withColumn("run_id", run), {"run_id": "string", **HISTORY_COLUMNS})


def write_history(history: DataFrame, path: str) -> None:
    history.select("run_id", *HISTORY_COLUMNS).hint("rebalance", F.col("run_id")).write.partitionBy("run_id").option("header", True).csv(path)


def scan_predictions(spark: SparkSession, paths: str | Sequence[str], runs: Sequence[str] | None = None) -> DataFrame:
    """Predictions of several runs; a run list prunes partitions."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    return df.where(F.col("run_id").isin(*runs)) if runs is not None else df


def write_predictions(preds: DataFrame, path: str) -> None:
    """One folder per run; a rebalance splits a hot run and merges small ones."""
    preds.hint("rebalance", F.col("run_id")).write.partitionBy("run_id").parquet(path)


def write_label_scores(scores: DataFrame, path: str) -> None:
    """Per-label CSV: six decimals, undefined left empty."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c))).alias(c)
    scores.select(
        "run_id", "label", F.col("frozen").cast("int").alias("in_clean_set"), F.col("n_pos").alias("n_positive"),
        text("auroc"), text("auprc"),
    ).hint("rebalance", F.col("run_id")).write.partitionBy("run_id").option("header", True).option("nullValue", "").csv(path)


def read_label_scores(spark: SparkSession, path: str) -> DataFrame:
    schema = "label string, in_clean_set int, n_positive bigint, auroc double, auprc double, run_id string"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_frozen_set(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(FROZEN_SCHEMA).option("multiLine", True).json(path)


def read_selection(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(SELECTION_SCHEMA).option("multiLine", True).json(path)


def read_manifests(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_scalers(spark: SparkSession, path) -> DataFrame:
    """Stored scalers; a file of another format version is an error."""
    df = spark.read.schema(SCALER_SCHEMA).option("multiLine", True).json(path)
    version = F.when(F.col("version").eqNullSafe(F.lit(SCALER_VERSION)), F.col("version")).otherwise(
        F.raise_error(F.lit("unknown scaler format version"))
    )
    return df.withColumn("version", version)


def write_psd(psd: DataFrame, path: str) -> None:
    """Mean spectrum; one row per bin, so one file."""
    psd.select("freq", "power").coalesce(1).write.parquet(path)


def read_psd(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("freq double, power double").parquet(path)


def write_nested_report(pairs: DataFrame, groups: DataFrame, delta: DataFrame, path: str, by: Sequence[str] = ("endpoint",)) -> None:
    """One JSON object per family and endpoint: its groups, pairs and verdict.

    The arrays hold one entry per compared group or pair, not rows of data.
    """
    by = list(by)
    pack = lambda df, name: df.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in by]))).alias(name)
    )
    verdict = delta.select(*by, F.struct(*[c for c in delta.columns if c not in by]).alias("delta"))
    pack(groups, "groups").join(pack(pairs, "pairs"), by).join(verdict, by).write.json(path)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Paths below a folder; the content column is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("lineSep", "\n").csv(path)
