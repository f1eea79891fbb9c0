"""Row-local plumbing shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder: cuts lineage and is computed once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def annotate(
    docs: DataFrame, text: str, fn: Callable[..., dict[str, pa.Array]], fields: str, keep: Sequence[str] = ("doc_id",), with_keys: bool = False
) -> DataFrame:
    """``keep`` columns and those that ``fn`` computes from an Arrow batch of texts.

    Other columns of ``docs`` are not read, so their names cannot clash.
    ``with_keys`` hands the ``keep`` columns to ``fn`` too.
    """
    added = T._parse_datatype_string(fields)
    names = [f.name for f in added]
    schema = T.StructType([docs.schema[c] for c in keep] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch.column(len(keep)), *(batch.columns[: len(keep)] if with_keys else []))
                cols = [batch.column(i) for i in range(len(keep))] + [made[n] for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("_text")).mapInArrow(run, schema)


def keep_where(docs: DataFrame, text: str, verdict: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text gets a true verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(verdict(batch.column(batch.schema.get_field_index(text))))

    return docs.mapInArrow(run, docs.schema)
