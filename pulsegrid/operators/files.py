"""Checksum manifests and file inventories as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def parse_checksums(lines: DataFrame, column: str = "value") -> DataFrame:
    """``<hex>  <path>`` or ``<hex> *<path>`` lines as ``(name, digest)``.

    Digests become lower case, separators ``/``; lines without two parts drop out.
    """
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    parts = F.split(text, r"\s+", 2)
    name = F.trim(F.regexp_replace(parts[1], r"^\*+", ""))
    return lines.where(F.size(parts) == 2).select(
        F.translate(name, "\\", "/").alias("name"), F.lower(parts[0]).alias("digest")
    )


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, content)`` rows, as the binary file source gives them, to digests."""
    return files.select(F.col("path").alias("name"), F.sha2("content", 256).alias("digest"))


def compare_files(listed: DataFrame, disk: DataFrame, skip_prefix: str | None = None,
                  manifest: str = "SHA256SUMS.txt") -> DataFrame:
    """``(name, status)`` with status verified, mismatched, missing or unexpected.

    ``unexpected`` is informational.  With ``skip_prefix`` listed names under the
    prefix are left out and no unexpected file is reported.  A name listed twice
    counts once; the aggregate shares the shuffle of the join.
    """
    a = listed.groupBy("name").agg(F.max("digest").alias("d1"))
    b = disk.select("name", F.col("digest").alias("d2")).where(F.col("name") != manifest)
    if skip_prefix:
        a = a.where(~F.col("name").startswith(skip_prefix))
        joined = a.join(b, "name", "left")
    else:
        joined = a.join(b, "name", "full_outer")
    status = (
        F.when(F.col("d2").isNull(), F.lit("missing"))
        .when(F.col("d1").isNull(), F.lit("unexpected"))
        .when(F.col("d1") != F.col("d2"), F.lit("mismatched"))
        .otherwise(F.lit("verified"))
    )
    return joined.select("name", status.alias("status"))


def missing_files(expected: DataFrame, disk: DataFrame, key: str = "name") -> DataFrame:
    return expected.select(key).join(disk.select(key), key, "left_anti")


def unexpected_files(expected: DataFrame, disk: DataFrame, key: str = "name") -> DataFrame:
    return disk.select(key).join(expected.select(key), key, "left_anti")


def file_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """Files per directory and extension."""
    p = F.col(path)
    leaf = F.element_at(F.split(p, "/"), -1)
    folder = F.regexp_replace(p, "/?[^/]*$", "")
    ext = F.when(leaf.contains("."), F.element_at(F.split(leaf, r"\."), -1)).otherwise(F.lit(""))
    return paths.select(folder.alias("dir"), ext.alias("ext")).groupBy("dir", "ext").agg(
        F.count(F.lit(1)).alias("n_files")
    )
