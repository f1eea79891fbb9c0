"""A sample of the registered queries against their SQL in DuckDB."""

import math
import os

import pytest

from pulsegrid.plans.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SAMPLE = (
    "auroc_per_label", "label_scores", "midrank", "macro_endpoints", "evaluate_logits", "align_runs", "bootstrap_weights", "percentile_ci",
    "compare_groups", "seed_mean_ci", "null_contrast", "interpret_delta", "holm_adjust", "label_support", "fold_table",
    "entity_leakage", "checksum_verify", "scan_history", "epoch_selection", "replicate_pairs", "config_fingerprint",
    "global_scaler", "fir_resample_12_25", "welch_psd", "band_excess", "window_alignment", "signal_profile", "ingest_signals", "notch_filter", "analyse_families",
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got == want and got[1]
