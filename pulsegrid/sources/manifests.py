"""Run manifests and environment sidecars: versioned JSON, read over many folders at once."""

from __future__ import annotations

import platform

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_MANIFEST_VERSION = 1
#: What a run's folder says about how the run came about.
RUN_MANIFEST = (
    "version int, run struct<run_id: string, block: int, fs: int, arm: string, notch: boolean, source: string, seed: int, selection: string>, "
    "train struct<epochs: int, batch_size: int, lr: double, weight_decay: double>, "
    "scaler struct<fs: int, notch: boolean, source: string, record_fingerprint: string, mean: double, std: double>, "
    "fingerprint string, git_sha string, device string, n_train_records bigint, n_val_records bigint, reduced_run boolean"
)
ENVIRONMENT = "python string, numpy string, pandas string, spark string, built_at timestamp"


def write_run_manifests(manifests: DataFrame, root: str) -> None:
    """One folder per run, one object in it; ``manifests`` has the fields of :data:`RUN_MANIFEST` but the version."""
    rows = manifests.withColumns({"version": F.lit(RUN_MANIFEST_VERSION), "folder": F.col("run.run_id")})
    rows.hint("rebalance", F.col("folder")).write.partitionBy("folder").json(root)


def read_run_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all run folders below ``root``, one row each, with the run's fields beside the others.

    Another format version, an object without a run, and a folder that is not its
    run's are errors.  Fields that a manifest lacks are NULL, others are not read.
    """
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    read = (
        spark.read.schema(RUN_MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
        .withColumn("folder", F.regexp_replace(folder, "^folder=", ""))
    )
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("folder")))
    checked = (
        F.when(F.col("run.run_id").isNull(), fail("a manifest without a run"))
        .when(~F.col("version").eqNullSafe(F.lit(RUN_MANIFEST_VERSION)), fail("unknown manifest version"))
        .when(F.col("run.run_id") != F.col("folder"), fail("a manifest in another run's folder"))
        .otherwise(F.col("version"))
    )
    return read.withColumn("version", checked).select("run.*", *[c for c in read.columns if c not in ("run", "folder")])


def current_environment(spark: SparkSession) -> dict[str, str]:
    return {"python": platform.python_version(), "numpy": np.__version__, "pandas": pd.__version__, "spark": spark.version}


def environment_report(spark: SparkSession, root: str) -> DataFrame:
    """``(store, built_on, package, stored, current, same)``: the versions each stored partition was built with against this session's.

    A store without a sidecar has no row.
    """
    read = spark.read.schema(ENVIRONMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{root}/environment")
    now = current_environment(spark)
    pairs = F.array(*[F.struct(F.lit(p).alias("package"), F.col(p).alias("stored"), F.lit(v).alias("current")) for p, v in now.items()])
    return read.select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("store"), F.to_date("built_at").alias("built_on"), F.inline(pairs)
    ).withColumn("same", F.col("stored").eqNullSafe(F.col("current")))
