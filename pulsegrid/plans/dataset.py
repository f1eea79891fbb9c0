"""Queries: record metadata, labels, splits, support, files and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import files, records
from ..session import scratch_dir
from ..sources import tables
from . import bindings as b
from .registry import query, rnd, with_

MIN_POSITIVES = 10
LABELS = ("view", "purchase", "refund")


def _coded(spark, sf):
    return records.with_codes(b.day_records(spark, sf))


# --- scans -----------------------------------------------------------------------------------

@query("scan_records", with_(b.ORDER_RECORDS) + """
SELECT record_id, patient_id, sex, age, fold, '{''F'': 100.0, ''N'': 0.0}' AS scp_codes,
       'lo/' || record_id AS filename_lr, 'hi/' || record_id AS filename_hr FROM order_records""")
def scan_records(spark, sf):
    path = scratch_dir(spark, "records")
    rows = b.order_records(spark, sf).withColumns({
        "scp_codes": F.lit("{'F': 100.0, 'N': 0.0}"),
        "filename_lr": F.concat(F.lit("lo/"), F.col("record_id").cast("string")),
        "filename_hr": F.concat(F.lit("hi/"), F.col("record_id").cast("string")),
    })
    tables.write_records(rows, path)
    return tables.scan_records(spark, path)


@query("scan_labels", with_(b.STATEMENTS) + "SELECT label, description FROM statements")
def scan_labels(spark, sf):
    path = scratch_dir(spark, "statements")
    tables.write_csv(b.statements(spark, sf), path)
    return tables.scan_labels(spark, path)


# --- code maps and labels --------------------------------------------------------------------------

@query("parse_code_map", with_(b.CODES) + "SELECT record_id, code, likelihood FROM codes")
def parse_code_map(spark, sf):
    return records.code_rows(_coded(spark, sf)).select("record_id", "code", "likelihood")


_DENSE = """
dense AS (
  SELECT r.record_id, r.fold, s.label, (c.code IS NOT NULL)::INT AS y FROM day_records r CROSS JOIN statements s
  LEFT JOIN codes c ON c.record_id = r.record_id AND c.code = s.label)"""


@query("label_presence", with_(b.CODES, b.STATEMENTS, _DENSE) + "SELECT record_id, label, y FROM dense")
def label_presence(spark, sf):
    return records.label_presence(_coded(spark, sf), b.statements(spark, sf)).select("record_id", "label", "y")


@query("label_restrict", with_(b.CODES, b.STATEMENTS, _DENSE) + """
SELECT record_id, (list_position(['view', 'purchase', 'refund'], label) - 1)::INT AS ordinal, label, y
FROM dense WHERE label IN ('view', 'purchase', 'refund')""")
def label_restrict(spark, sf):
    return records.label_presence(_coded(spark, sf), LABELS).select("record_id", "ordinal", "label", "y")


@query("label_positives", with_(b.CODES, b.STATEMENTS, _DENSE) + "SELECT record_id, label FROM dense WHERE y = 1")
def label_positives(spark, sf):
    return records.label_positives(_coded(spark, sf), b.statements(spark, sf)).select("record_id", "label")


@query("unlabelled_records", with_(b.CODES, b.STATEMENTS, _DENSE) + """
SELECT record_id FROM dense GROUP BY record_id HAVING sum(y) = 0""")
def unlabelled_records(spark, sf):
    return records.unlabelled(_coded(spark, sf), b.statements(spark, sf)).select("record_id")


_SUPPORT = """
support AS (
  SELECT s.label, s.description, coalesce(sum(y), 0)::BIGINT AS n_total,
         coalesce(sum(y) FILTER (fold BETWEEN 1 AND 8), 0)::BIGINT AS n_train,
         coalesce(sum(y) FILTER (fold = 10), 0)::BIGINT AS n_test,
         round_even(100 * sum(y)::DOUBLE / count(*), 3) AS prevalence_pct
  FROM dense d JOIN statements s USING (label) GROUP BY s.label, s.description),
sup AS (SELECT *, n_test >= 10 AS in_macro_clean FROM support)"""


def _support(spark, sf):
    return records.label_support(_coded(spark, sf), b.statements(spark, sf), MIN_POSITIVES)


@query("label_support", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + "SELECT * FROM sup")
def label_support(spark, sf):
    return _support(spark, sf)


@query("rarest_labels", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + """
SELECT label, n_test, prevalence_pct, in_macro_clean FROM sup ORDER BY n_test, label DESC LIMIT 3""")
def rarest_labels(spark, sf):
    return records.rarest_labels(_support(spark, sf), 3).select("label", "n_test", "prevalence_pct", "in_macro_clean")


@query("frozen_label_set", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + """
SELECT label, 10 AS min_test_positives, 10 AS test_fold, (SELECT count(*) FROM sup) AS n_labels_all,
       (SELECT count(*) FROM sup WHERE in_macro_clean) AS n_labels_clean FROM sup WHERE in_macro_clean""")
def frozen_label_set(spark, sf):
    path = scratch_dir(spark, "frozen")
    tables.write_json(records.frozen_set(_support(spark, sf), MIN_POSITIVES), path)
    return tables.read_frozen_set(spark, path).select(
        F.explode("labels_clean").alias("label"), "min_test_positives", "test_fold", "n_labels_all", "n_labels_clean"
    )


@query("frozen_columns", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + """
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS ordinal FROM sup WHERE in_macro_clean""")
def frozen_columns(spark, sf):
    frozen = records.frozen_set(_support(spark, sf), MIN_POSITIVES)
    return records.frozen_columns(frozen, b.statements(spark, sf)).select("label", "ordinal")


@query("frozen_drift", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + """
, old AS (SELECT label FROM statements WHERE label IN ('click', 'refund', 'view'))
SELECT label, 'frozen_only' AS side FROM (SELECT label FROM old EXCEPT SELECT label FROM sup WHERE in_macro_clean)
UNION ALL
SELECT label, 'derived_only' FROM (SELECT label FROM sup WHERE in_macro_clean EXCEPT SELECT label FROM old)""")
def frozen_drift(spark, sf):
    old = b.statements(spark, sf).where(F.col("label").isin("click", "refund", "view"))
    return records.frozen_drift(old, _support(spark, sf).where("in_macro_clean"))


@query("label_checks", with_(b.CODES, b.STATEMENTS, _DENSE, _SUPPORT) + """
SELECT unnest(['dictionary_size', 'every_record_labelled', 'clean_labels', 'frozen_threshold', 'frozen_test_fold', 'frozen_equals_derived']) AS check_name,
       unnest([n = 5, bare = 0, clean = 4, true, true, kept = derived]) AS ok,
       unnest([n::VARCHAR, bare::VARCHAR, clean::VARCHAR, '10', '10', array_to_string(derived, ',')]) AS detail
FROM (SELECT count(*) AS n, count(*) FILTER (in_macro_clean) AS clean,
             list(label ORDER BY label) FILTER (in_macro_clean) AS derived,
             list(label ORDER BY label) FILTER (in_macro_clean AND label <> 'click') AS kept,
             (SELECT count(*) FROM (SELECT record_id FROM dense GROUP BY record_id HAVING sum(y) = 0)) AS bare FROM sup)""")
def label_checks(spark, sf):
    frozen = records.frozen_set(_support(spark, sf), MIN_POSITIVES).withColumn(
        "labels_clean", F.filter("labels_clean", lambda x: x != "click")
    )
    return records.label_checks(_coded(spark, sf), b.statements(spark, sf), frozen, n_labels=5, n_clean=4)


# --- splits -----------------------------------------------------------------------------------------

@query("split_assign", with_(b.ORDER_RECORDS) + f"SELECT record_id, patient_id, fold, {b.SPLIT_SQL} AS split FROM order_records")
def split_assign(spark, sf):
    return records.refuse_leakage(b.order_records(spark, sf)).select("record_id", "patient_id", "fold", "split")


@query("split_coverage", with_(b.ORDER_RECORDS) + f"""
SELECT split, count(*) AS n_records, (SELECT count(*) FROM order_records) AS total, true AS covers_all
FROM (SELECT {b.SPLIT_SQL} AS split FROM order_records) GROUP BY split""")
def split_coverage(spark, sf):
    return records.split_coverage(b.order_records(spark, sf))


@query("entity_leakage", with_(b.ORDER_RECORDS, f"""
p AS (
  SELECT patient_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS v, bool_or(split = 'test') AS t,
         count(DISTINCT fold) AS f
  FROM (SELECT patient_id, fold, {b.SPLIT_SQL} AS split FROM (SELECT patient_id, leaking_fold AS fold FROM order_records))
  GROUP BY patient_id)""") + """
SELECT 'train/val' AS scope, count(*) AS n_entities, min(patient_id) AS first_entity FROM p WHERE a AND v
UNION ALL SELECT 'train/test', count(*), min(patient_id) FROM p WHERE a AND t
UNION ALL SELECT 'val/test', count(*), min(patient_id) FROM p WHERE v AND t
UNION ALL SELECT 'fold', count(*), min(patient_id) FROM p WHERE f > 1""")
def entity_leakage(spark, sf):
    return records.entity_leakage(b.order_records(spark, sf, leaking=True))


@query("fold_table", with_(b.ORDER_RECORDS) + f"""
SELECT fold, CASE {b.SPLIT_SQL} WHEN 'val' THEN 'validation' ELSE {b.SPLIT_SQL} END AS split, count(*) AS records,
       count(DISTINCT patient_id) AS patients, round_even(100 * avg(sex), 1) AS female_pct,
       round(quantile_cont(age, 0.5::DOUBLE), 6) AS age_median FROM order_records GROUP BY fold""")
def fold_table(spark, sf):
    return records.fold_table(b.order_records(spark, sf)).withColumn("age_median", rnd("age_median", 6))


@query("dataset_counts", with_(b.ORDER_RECORDS) + """
SELECT count(*) AS n_records, count(DISTINCT patient_id) AS n_patients, count(*) = 15000 AS records_ok,
       count(DISTINCT patient_id) = 1500 AS patients_ok FROM order_records""")
def dataset_counts(spark, sf):
    return records.dataset_counts(b.order_records(spark, sf), 15000, 1500)


@query("hash_sample", with_(b.ORDER_RECORDS) + """
SELECT record_id, patient_id FROM order_records WHERE leaking_fold <= 8
ORDER BY md5('0:' || record_id), record_id LIMIT 500""")
def hash_sample(spark, sf):
    pool = b.order_records(spark, sf, leaking=True).where(records.split_of() == "train")
    return records.hash_sample(pool, "record_id", 500).select("record_id", "patient_id")


# --- files ----------------------------------------------------------------------------------------------

@query("parse_checksums", with_(b.FILES) + "SELECT name, digest FROM listed")
def parse_checksums(spark, sf):
    return files.parse_checksums(b.manifest_lines(spark, sf))


@query("checksum_verify", with_(b.FILES) + """
SELECT name, CASE WHEN d.digest IS NULL THEN 'missing' WHEN l.digest IS NULL THEN 'unexpected'
                  WHEN l.digest <> d.digest THEN 'mismatched' ELSE 'verified' END AS status
FROM listed l FULL OUTER JOIN disk d USING (name)""")
def checksum_verify(spark, sf):
    return files.compare_files(files.parse_checksums(b.manifest_lines(spark, sf)), b.disk_files(spark, sf))


@query("checksum_quick", with_(b.FILES) + """
SELECT status, count(*) AS n_files FROM (
  SELECT CASE WHEN d.digest IS NULL THEN 'missing' WHEN l.digest <> d.digest THEN 'mismatched' ELSE 'verified' END AS status
  FROM listed l LEFT JOIN disk d USING (name) WHERE NOT starts_with(name, 'src0/')) GROUP BY status""")
def checksum_quick(spark, sf):
    listed = files.parse_checksums(b.manifest_lines(spark, sf))
    return files.compare_files(listed, b.disk_files(spark, sf), skip_prefix="src0/").groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files")
    )


@query("missing_files", with_(b.FILES) + """
SELECT name FROM listed EXCEPT SELECT name FROM disk""")
def missing_files(spark, sf):
    listed = files.parse_checksums(b.manifest_lines(spark, sf))
    return files.missing_files(listed, b.disk_files(spark, sf))


@query("unexpected_files", with_(b.FILES) + "SELECT name FROM disk EXCEPT SELECT name FROM listed")
def unexpected_files(spark, sf):
    listed = files.parse_checksums(b.manifest_lines(spark, sf))
    return files.unexpected_files(listed, b.disk_files(spark, sf))


@query("file_inventory", """
SELECT source || '/' || lang AS dir, ['hea', 'dat', ''][doc_id % 3 + 1] AS ext, count(*) AS n_files
FROM documents GROUP BY ALL""")
def file_inventory(spark, sf):
    ext = F.element_at(F.array(F.lit(".hea"), F.lit(".dat"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return files.file_inventory(b.table(spark, sf, "documents").select(path.alias("path")))


@query("integrity_report", with_(b.ORDER_RECORDS) + """
SELECT unnest(['record_count', 'patient_count', 'files_present', 'patients_in_one_fold']) AS check_name,
       unnest([n = 15000, p = 1500, missing = 0, leaks = 0]) AS ok,
       unnest([n::VARCHAR, p::VARCHAR, missing::VARCHAR, leaks::VARCHAR]) AS detail
FROM (SELECT count(*) AS n, count(DISTINCT patient_id) AS p,
             count(*) FILTER (record_id % 29 = 0) AS missing,
             (SELECT count(*) FROM (SELECT patient_id FROM order_records GROUP BY patient_id HAVING count(DISTINCT leaking_fold) > 1)) AS leaks
      FROM order_records)""")
def integrity_report(spark, sf):
    rows = b.order_records(spark, sf, leaking=True)
    disk = b.table(spark, sf, "orders").where(F.col("o_orderkey") % 29 != 0).select(F.col("o_orderkey").alias("record_id"))
    return records.integrity_report(rows, disk, 15000, 1500)
