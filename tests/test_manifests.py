"""Run manifests over many folders, and environment sidecars."""

import json

import pytest

from pulsegrid.sources import manifests


def _manifest(root, folder, **fields):
    (root / folder).mkdir(parents=True, exist_ok=True)
    run = {"run_id": folder, "block": 1, "fs": 100, "arm": "A", "notch": True, "source": "hr", "seed": 3, "selection": "macro_clean"}
    body = {"version": 1, "run": run, "fingerprint": "ab", "train": {"epochs": 7}, "unknown": [1]} | fields
    (root / folder / "manifest.json").write_text(json.dumps({k: v for k, v in body.items() if v is not None}, indent=2))


def test_manifests_of_many_folders(spark, tmp_path):
    for name in ("b1-s0", "b1-s1", "b2-s0"):
        _manifest(tmp_path, name)
    rows = manifests.read_run_manifests(spark, str(tmp_path)).orderBy("run_id").collect()
    assert [r["run_id"] for r in rows] == ["b1-s0", "b1-s1", "b2-s0"]
    assert rows[0]["seed"] == 3 and rows[0]["train"]["epochs"] == 7 and rows[0]["scaler"] is None and rows[0]["git_sha"] is None


@pytest.mark.parametrize("fields, match", [
    ({"version": 2}, "unknown manifest version"), ({"version": None}, "unknown manifest version"), ({"run": None}, "without a run"),
    ({"run": {"run_id": "other"}}, "another run's folder"),
])
def test_bad_manifests_are_refused(spark, tmp_path, fields, match):
    _manifest(tmp_path, "good")
    _manifest(tmp_path, "bad", **fields)
    with pytest.raises(Exception, match=match):
        manifests.read_run_manifests(spark, str(tmp_path)).collect()


def test_sidecars_are_compared(spark, tmp_path):
    now = manifests.current_environment(spark)
    for store, versions in (("hr_fs100_notch1", now), ("lr_fs100_notch0", now | {"spark": "1.0", "numpy": None})):
        folder = tmp_path / "environment" / store
        folder.mkdir(parents=True)
        (folder / "part-0.json").write_text(json.dumps(versions | {"built_at": "2024-03-01T10:00:00.000Z"}))
    got = {(r["store"], r["package"]): (r["same"], str(r["built_on"])) for r in manifests.environment_report(spark, str(tmp_path)).collect()}
    assert len(got) == 8 and {k for k, v in got.items() if not v[0]} == {("lr_fs100_notch0", "spark"), ("lr_fs100_notch0", "numpy")}
    assert {v[1] for v in got.values()} == {"2024-03-01"}
