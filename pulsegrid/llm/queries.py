"""The registered queries of the subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_license_templates, op2_contextual_pii, op3_line_dedup, op4_knn_quality, op5_linked_secrets, op6_warc, op7_winnowing, op8_packing,
    op9_ngram_jaccard, op10_repetition, op11_periodic_runs, op12_spelling_variants, op13_minhash_stars,
)
from .oracles import ORACLES

__all__ = ["QUERIES", "ORACLES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_templates": op1_license_templates.query,
    "op2_contextual_pii": op2_contextual_pii.query,
    "op3_line_dedup": op3_line_dedup.query,
    "op4_knn_quality": op4_knn_quality.query,
    "op5_linked_secrets": op5_linked_secrets.query,
    "op6_warc": op6_warc.query,
    "op7_winnowing": op7_winnowing.query,
    "op8_packing": op8_packing.query,
    "op9_ngram_jaccard": op9_ngram_jaccard.query,
    "op10_repetition": op10_repetition.query,
    "op11_periodic_runs": op11_periodic_runs.query,
    "op12_spelling_variants": op12_spelling_variants.query,
    "op13_minhash_stars": op13_minhash_stars.query,
}
