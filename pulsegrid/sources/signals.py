"""Signal files in, partitioned signal tables out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import format16
from ..functions.exprs import set_fingerprint
from ..session import written
from .manifests import current_environment
from .tables import list_files

STORE_VERSION = 1
KEYS = ("source", "fs", "notch")
MANIFEST = "version int, source string, fs int, notch boolean, n_records bigint, n_samples int, record_fingerprint string"


def ingest_signals(files: DataFrame, n_leads: int | DataFrame | None = 12, n_samples: int | None = None) -> DataFrame:
    """``(path, content)`` of header and data files to ``(stem, lead, lead_name, fs, samples)``.

    Headers and data meet on the path stem; decoding is row-local.  Wrong lead or
    sample counts fail.  Records with different numbers of leads have theirs in a
    table ``(stem, n_leads)``; a record that it lacks fails.
    """
    own = isinstance(n_leads, DataFrame)
    stem = F.regexp_replace("path", r"\.(hea|dat)$", "")
    headers = files.where(F.col("path").endswith(".hea")).select(stem.alias("stem"), F.col("content").cast("string").alias("header"))
    data = files.where(F.col("path").endswith(".dat")).select(stem.alias("stem"), F.col("content").alias("data"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, text, blob, want in zip(batch["stem"], batch["header"], batch["data"], batch["want"]):
                head = format16.parse_header(text)
                x = format16.decode(head, blob)
                if want >= 0 and len(x) != want:
                    raise ValueError(f"{s}: {len(x)} leads instead of {want}")
                if n_samples is not None and x.shape[1] != n_samples:
                    raise ValueError(f"{s}: {x.shape[1]} samples instead of {n_samples}")
                yield pd.DataFrame({
                    "stem": s, "lead": np.arange(len(x), dtype=np.int32), "lead_name": head["lead"],
                    "fs": np.int32(round(head["fs"])), "samples": list(x),
                })

    both = headers.join(data, "stem")
    if own:
        both = both.join(n_leads.select("stem", F.col("n_leads").cast("int").alias("want")), "stem", "left").withColumn("want", F.coalesce("want", F.lit(0)))
    else:
        both = both.withColumn("want", F.lit(-1 if n_leads is None else n_leads))
    return both.mapInPandas(
        decode, "stem string, lead int, lead_name string, fs int, samples array<double>"
    )


#: Column of the record table that holds a record's path, by signal source.
PATH_COLUMNS = {"hr": "filename_hr", "lr": "filename_lr"}
#: Bytes of signal files that one task reads.
BYTES_PER_TASK = 64 << 20
SIGNAL_ROWS = "record_id {id}, source string, lead int, lead_name string, fs int, samples array<double>"


def _opened(root: str, name: str) -> tuple[pafs.FileSystem, str]:
    uri = f"{root.rstrip('/')}/{name}"
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def signal_rows(records: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of decoded records ``(id, source, header, samples by lead)``, built from the arrays as they are."""
    ids, sources, leads, names, rates, parts, length = [], [], [], [], [], [], []
    for key, source, head, x in records:
        n = len(x)
        ids += [key] * n
        sources += [source] * n
        leads += range(n)
        names += head["lead"]
        rates += [round(head["fs"])] * n
        parts.append(x.reshape(-1))
        length += [x.shape[1]] * n
    offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
    samples = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)))
    columns = [pa.array(c, f.type) for c, f in zip((ids, sources, leads, names, rates), schema)]
    return pa.RecordBatch.from_arrays([*columns, samples.cast(schema.field(5).type)], schema=schema)


def read_signal_files(
    records: DataFrame, root: str, source: str = "hr", id_col: str = "record_id", n_leads: int | None = 12, n_samples: int | None = None,
    bytes_per_task: int = BYTES_PER_TASK, columns: dict[str, str] = PATH_COLUMNS, leads: str | None = None,
) -> DataFrame:
    """Signals of the records, from the files that ``source`` names in each record's own row.

    Only ids and paths move; every task opens the header and data files of its
    records, whose number follows from the files' bytes.  A missing file, a record
    without a path, and wrong lead or sample counts fail.  ``leads`` names the column
    that holds a record's own number of leads, instead of ``n_leads`` for all.  Other
    columns of ``records`` are not read.
    """
    if source not in columns:
        raise ValueError(f"unknown signal source {source!r}")
    spark = records.sparkSession
    name = F.col(columns[source])
    known = F.when(name.isNull() | (name == ""), F.raise_error(F.concat(F.lit("no path of source "), F.lit(source)))).otherwise(name)
    want = F.lit(n_leads) if leads is None else F.coalesce(F.col(leads), F.lit(0))
    pairs = records.select(F.col(id_col).alias("record_id"), known.alias("name"), want.cast("int").alias("leads"))
    held = list_files(spark, root, "*.dat").agg(F.sum("length"), F.count(F.lit(1))).first()
    mean = (held[0] or 0) / max(1, held[1])
    tasks = max(spark.sparkContext.defaultParallelism, int(pairs.count() * mean // bytes_per_task) + 1)
    kind = T._parse_datatype_string(SIGNAL_ROWS.format(id=records.schema[id_col].dataType.simpleString()))
    schema = to_arrow_schema(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cells = 0
        for batch in batches:
            for key, path, expected in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, at = _opened(root, path)
                with fs.open_input_file(f"{at}.hea") as f:
                    head = format16.parse_header(f.read().decode())
                with fs.open_input_file(f"{at}.dat") as f:
                    x = format16.decode(head, f.read())
                if expected is not None and len(x) != expected:
                    raise ValueError(f"{path}: {len(x)} leads instead of {expected}")
                if n_samples is not None and x.shape[1] != n_samples:
                    raise ValueError(f"{path}: {x.shape[1]} samples instead of {n_samples}")
                rows.append((key, source, head, np.ascontiguousarray(x)))
                cells += x.size
                if cells >= 1 << 20:
                    yield signal_rows(rows, schema)
                    rows, cells = [], 0
        if rows:
            yield signal_rows(rows, schema)

    return pairs.repartition(tasks, "name").mapInArrow(read, kind)


def write_signal_files(signals: DataFrame, root: str, name: str = "name", gain: float = 1000.0) -> DataFrame:
    """Header and data files of records, for fixtures and exports; ``(name, bytes)`` of each.

    ``signals`` has ``name`` (path below ``root``), lead, fs and samples.  A record
    has few leads, so gathering them is bounded; a lead is named after its number.
    """
    held = F.sort_array(F.collect_list(F.struct("lead", "samples")))
    per = signals.groupBy(F.col(name).alias("name")).agg(F.max("fs").alias("fs"), held.alias("held")).select(
        "name", "fs", "held.samples", "held.lead"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path, rate, x, lead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                head, blob = format16.encode(path.rpartition("/")[2], int(rate), np.array(x, dtype=float), gain, lead)
                fs, at = _opened(root, path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                for suffix, body in (("hea", head.encode()), ("dat", blob)):
                    with fs.open_output_stream(f"{at}.{suffix}") as f:
                        f.write(body)
                sizes.append(len(blob))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return written(per.mapInArrow(write, "name string, bytes long"), "signal-files")


def encode_signals(signals: DataFrame, gain: float = 1000.0, path: str = "record") -> DataFrame:
    """The inverse of ingest for fixtures: rows ``(path, content)`` of header and data files.

    A record has few leads, so gathering them is bounded; a lead is named after its number.
    """
    held = F.sort_array(F.collect_list(F.struct("lead", "samples")))
    per = signals.groupBy("record_id").agg(F.max("fs").alias("fs"), held.alias("held")).select(
        "record_id", "fs", F.col("held.samples").alias("x"), F.col("held.lead").alias("lead")
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rid, fs, x, lead in zip(batch["record_id"], batch["fs"], batch["x"], batch["lead"]):
                name = f"{rid:05d}"
                head, blob = format16.encode(name, int(fs), np.stack([np.asarray(v, dtype=float) for v in x]), gain, lead)
                rows += [(f"{path}/{name}.hea", head.encode()), (f"{path}/{name}.dat", blob)]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return per.mapInPandas(encode, "path string, content binary")


# --- the store ---------------------------------------------------------------------------

def _expected(signals: DataFrame, source: str, fs: int, notch: bool, n_samples: int) -> dict:
    r = signals.select("record_id").distinct().agg(
        set_fingerprint("record_id").alias("fp"), F.count(F.lit(1)).alias("n")
    ).first()
    return {
        "version": STORE_VERSION, "source": source, "fs": fs, "notch": notch,
        "n_records": r["n"], "n_samples": n_samples, "record_fingerprint": r["fp"],
    }


def read_manifest(spark: SparkSession, root: str, source: str, fs: int, notch: bool) -> dict | None:
    try:
        rows = spark.read.schema(MANIFEST).json(f"{root}/manifests/{source}_fs{fs}_notch{int(notch)}").take(1)
    except AnalysisException:
        return None
    return rows[0].asDict() if rows else None


def write_signals(signals: DataFrame, root: str, *, source: str, fs: int, notch: bool, n_samples: int,
                  records: DataFrame | None = None, overwrite: bool = False) -> bool:
    """Store one ``(source, fs, notch)`` partition; False when it was already there.

    The manifest is written after the data, so an interrupted build is rebuilt.
    Library versions go into a sidecar next to it.
    """
    spark = signals.sparkSession
    want = _expected(records if records is not None else signals, source, fs, notch, n_samples)
    if not overwrite and read_manifest(spark, root, source, fs, notch) == want:
        return False
    size = F.when(F.size("samples") == n_samples, F.col("samples")).otherwise(
        F.raise_error(F.lit(f"a signal does not have {n_samples} samples"))
    )
    rows = signals.withColumns({
        "samples": size.cast("array<float>"), "source": F.lit(source), "fs": F.lit(fs),
        "notch": F.lit(int(notch)),  # folder names carry 0/1
    })
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{root}/signals")
    name = f"{source}_fs{fs}_notch{int(notch)}"
    spark.createDataFrame([want], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{name}")
    versions = current_environment(spark)
    spark.createDataFrame([versions]).withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{root}/environment/{name}")
    return True


def read_signals(spark: SparkSession, root: str, *, rates: Sequence[int], source: str = "hr", notch: bool = True,
                 records: DataFrame | None = None) -> DataFrame:
    """Stored signals at one or several rates, partitions pruned.

    A rate without a coherent manifest is refused; with ``records`` the stored set
    of records must be exactly that one.
    """
    want = None
    if records is not None:
        want = records.select("record_id").distinct().agg(set_fingerprint("record_id")).first()[0]
    for fs in rates:
        have = read_manifest(spark, root, source, fs, notch)
        if have is None or have["version"] != STORE_VERSION or (have["source"], have["fs"], have["notch"]) != (source, fs, notch):
            raise FileNotFoundError(f"no coherent store for {source}, {fs} Hz, notch={notch}")
        if want is not None and have["record_fingerprint"] != want:
            raise FileNotFoundError(f"the store at {fs} Hz holds other records")
    stored = spark.read.parquet(f"{root}/signals").where(
        (F.col("source") == source) & F.col("fs").isin(*rates) & (F.col("notch") == int(notch))
    )
    return stored.withColumn("notch", F.col("notch") == 1)
