"""The corpus pipeline: ``documents`` through five stages, each a written table of its own.

``run(spark, sf_dir)`` applies :data:`STAGES`.  Every stage works on all that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import op3_line_dedup, op7_winnowing, op8_packing, op9_ngram_jaccard, op10_repetition
from pulsegrid.llm.rows import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the suffix-array repetition rules reject go."""
    return op10_repetition.keep_unrepetitive(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before, up to one edit, are cut; documents whose lines, short ones included, were all seen before go."""
    return op3_line_dedup.remove_repeated_lines(docs, short_lines=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarity of 0.75 or more stays."""
    return op9_ngram_jaccard.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return op7_winnowing.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in as few sequences as possible."""
    return op8_packing.pack_documents(docs, op8_packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: SQL cannot express suffix arrays with limits, edit distance components or BPE; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
