"""Signals: filtering, resampling, windows, scaling, spectra and quality checks.

A signal is one row per record and lead with its samples in an array, so every
kernel is row-local and nothing is shuffled to compute it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels
from ..functions.exprs import (
    fingerprint_merge, fingerprint_of, fingerprint_parts, fingerprint_start, hash_draw, samples_finite, set_fingerprint, whole_samples,
)
from ..session import written
from .prefix import exact_quantiles
from .records import TRAIN_FOLDS, check_rows

# The study's rates, spans and filter settings.
SOURCE_FS = 500
RATES = (100, 240, 250, 500)
RECORD_DS = 100
WINDOW_DS = 25
GRID_DS = 1
NOTCH_HZ = 50.0
NOTCH_Q = 30.0

#: Rows stacked at a time inside a kernel; bounds task memory, not results.
KERNEL_ROWS = 512


# --- I4-I7: parameter checks -------------------------------------------------------------

def check_rates(rates: Sequence[int] = RATES, source_fs: int = SOURCE_FS, record_ds: int = RECORD_DS,
                window_ds: int = WINDOW_DS, grid_ds: int = GRID_DS) -> None:
    """Every span is a whole number of samples at every rate and windows tile the record."""
    for fs in rates:
        up, down = kernels.rate_factors(source_fs, fs)
        if source_fs * up != fs * down:
            raise ValueError(f"no whole factors from {source_fs} to {fs} Hz")
        for span in (record_ds, window_ds, grid_ds):
            whole_samples(span, fs)
    if record_ds % window_ds:
        raise ValueError("windows do not tile the record")


def crop_starts(record_ds: int = RECORD_DS, window_ds: int = WINDOW_DS, grid_ds: int = GRID_DS) -> list[int]:
    """Admissible starts in deciseconds."""
    return list(range(0, record_ds - window_ds + 1, grid_ds))


def tiling_starts(record_ds: int = RECORD_DS, window_ds: int = WINDOW_DS) -> list[int]:
    """Starts of the windows that tile the record."""
    return list(range(0, record_ds - window_ds + 1, window_ds))


# --- kernels over array rows -----------------------------------------------------------------

def map_samples(
    df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], element: str = "float", column: str = "samples"
) -> DataFrame:
    """Replace the sample array by ``kernel`` of it, in Arrow batches.

    Rows of equal length are stacked, at most ``KERNEL_ROWS`` of them, and go on
    before the next are read: a task holds one incoming batch and one such slice,
    however many rows it has.
    """
    dtype = np.float32 if element == "float" else np.float64
    kind = T.ArrayType(T.FloatType() if element == "float" else T.DoubleType())
    schema = T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema])
    arrow = to_arrow_schema(schema)
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, KERNEL_ROWS):
                part = batch.slice(lo, KERNEL_ROWS)
                lists = part.column(place)
                if lists.null_count:
                    raise ValueError(f"a row without {column}")
                lengths = lists.value_lengths().to_numpy()
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.cumsum(lengths) - lengths
                done: list = [None] * len(lengths)
                for n in np.unique(lengths):
                    where = np.flatnonzero(lengths == n)
                    for i, row in zip(where, kernel(flat[starts[where][:, None] + np.arange(n)]).astype(dtype)):
                        done[i] = row
                offsets = pa.array(np.cumsum([0, *map(len, done)]).astype(np.int32))
                columns = list(part.columns)
                columns[place] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(done))).cast(arrow.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return df.mapInArrow(run, schema)


def notch_filter(signals: DataFrame, fs: int = SOURCE_FS, f0: float = NOTCH_HZ, q: float = NOTCH_Q,
                 source_fs: int = SOURCE_FS) -> DataFrame:
    """Zero-phase mains notch, only at the source rate and so before any resampling."""
    if fs != source_fs:
        raise ValueError(f"the notch runs at {source_fs} Hz before resampling, not at {fs} Hz")
    return map_samples(signals, lambda x: kernels.notch(x, f0, q, fs), "double")


def resample(signals: DataFrame, target_fs: int, source_fs: int = SOURCE_FS, rates: Sequence[int] = RATES,
             element: str = "double") -> DataFrame:
    """Rational resampling from the source rate; identity is a cast."""
    if target_fs not in rates:
        raise ValueError(f"rate not in the protocol: {target_fs}")
    check_rates(rates, source_fs)
    up, down = kernels.rate_factors(source_fs, target_fs)
    return map_samples(signals, lambda x: kernels.resample(x, up, down), element)


def preprocess(signals: DataFrame, target_fs: int, notch: bool = True, source_fs: int = SOURCE_FS,
               rates: Sequence[int] = RATES, f0: float = NOTCH_HZ, q: float = NOTCH_Q) -> DataFrame:
    """Notch, then resampling, float64 inside and float32 out, in one pass over the rows."""
    if target_fs not in rates:
        raise ValueError(f"rate not in the protocol: {target_fs}")
    check_rates(rates, source_fs)
    up, down = kernels.rate_factors(source_fs, target_fs)

    def both(x: np.ndarray) -> np.ndarray:
        return kernels.resample(kernels.notch(x, f0, q, source_fs) if notch else x, up, down)

    done = map_samples(signals, both, "float")
    return done.withColumns({"fs": F.lit(target_fs), "notch": F.lit(notch)})


# --- windows -----------------------------------------------------------------------------------

def crop(signals: DataFrame, width_ds: int, start: str = "start_ds", fs: str = "fs") -> DataFrame:
    """The window that starts at ``start`` deciseconds; outside the record is an error."""
    rate = F.col(fs).cast("bigint")
    begin, width = F.col(start) * rate / 10, rate * width_ds / 10
    whole = (F.pmod(F.col(start) * rate, F.lit(10)) == 0) & (F.pmod(rate * width_ds, F.lit(10)) == 0)
    inside = (F.col(start) >= 0) & (begin + width <= F.size("samples"))
    cut = (
        F.when(~whole, F.raise_error(F.lit("window is not a whole number of samples")))
        .when(~inside, F.raise_error(F.lit("window leaves the record")))
        .otherwise(F.slice("samples", (begin + 1).cast("int"), width.cast("int")))
    )
    return signals.withColumn("samples", cut)


def inference_windows(signals: DataFrame, record_ds: int = RECORD_DS, width_ds: int = WINDOW_DS) -> DataFrame:
    """All tiling windows of every row; an ``explode``, no join."""
    starts = F.array(*[F.lit(s) for s in tiling_starts(record_ds, width_ds)])
    return crop(signals.withColumn("start_ds", F.explode(starts)), width_ds)


def seeded_start(seed: int, epoch, record: str = "record_id", record_ds: int = RECORD_DS,
                 width_ds: int = WINDOW_DS, grid_ds: int = GRID_DS) -> Column:
    """Random start in deciseconds: a function of seed, epoch and record, never of the rate."""
    n = len(crop_starts(record_ds, width_ds, grid_ds))
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return (hash_draw(n, F.lit(str(seed)), e, F.col(record)) * grid_ds).cast("int")


def seeded_crop(signals: DataFrame, seed: int, epoch: int, record_ds: int = RECORD_DS,
                width_ds: int = WINDOW_DS) -> DataFrame:
    return crop(
        signals.withColumn("start_ds", seeded_start(seed, epoch, record_ds=record_ds, width_ds=width_ds)), width_ds
    )


# --- scaler ---------------------------------------------------------------------------------------

def _merged(left: Column, right: Column) -> Column:
    """Moments ``(n, mean, m2)`` of two sets of values together."""
    n = left["n"] + right["n"]
    step = right["mean"] - left["mean"]
    share = right["n"].cast("double") / n
    whole = F.struct(
        n.alias("n"), (left["mean"] + step * share).alias("mean"), (left["m2"] + right["m2"] + step * step * left["n"] * share).alias("m2")
    )
    return F.when(left["n"] == 0, right).when(right["n"] == 0, left).otherwise(whole)


def fit_scaler(signals: DataFrame, by: Sequence[str] = ("fs", "notch", "source")) -> DataFrame:
    """One mean and one standard deviation over all samples of the training folds.

    Every row gives its count, mean and sum of squared deviations, a task merges
    those of its rows pairwise, and so do the tasks' results: no sample leaves its
    row, and a large common offset cancels nowhere.  The fingerprint of the records
    used is part of the same aggregate.  NULL samples do not count.
    """
    by = list(by)
    train = signals.where(F.col("fold").between(*TRAIN_FOLDS))
    kinds = [train.schema[c] for c in by]
    fields = [T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())]
    prints = fingerprint_parts("record_id", "lead")
    schema = T.StructType([*kinds, *fields, *[T.StructField(c, t) for c, (_, t) in prints.items()]])
    n_keys, n_prints = len(by), len(prints)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)])) if n_keys else [()] * batch.num_rows
            lists = batch.column(n_keys)
            marks = [batch.column(n_keys + 1 + i).to_pylist() for i in range(n_prints)]
            for row, key in enumerate(keys):
                values = lists[row].values
                x = np.zeros(0) if values is None else values.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                n, mean = len(x), float(x.mean()) if len(x) else 0.0
                m2 = float(((x - mean) ** 2).sum())
                at = held.setdefault(key, [0, 0.0, 0.0, *fingerprint_start()])
                if n:
                    whole, step = at[0] + n, mean - at[1]
                    at[2] += m2 + step * step * at[0] * n / whole
                    at[1] += step * n / whole
                    at[0] = whole
                at[3:] = fingerprint_merge(at[3:], [m[row] for m in marks])
        if held:
            columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(to_arrow_schema(T.StructType(kinds)))]
            rest = to_arrow_schema(T.StructType(list(schema)[n_keys:]))
            columns += [pa.array([v[i] for v in held.values()], f.type) for i, f in enumerate(rest)]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    parts = train.select(*by, "samples", *[c.alias(name) for name, (c, _) in prints.items()]).mapInArrow(per_task, schema)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = parts.groupBy(*by).agg(
        F.aggregate(F.collect_list(F.struct("n", "mean", "m2")), zero, _merged).alias("k"),  # one entry per task
        fingerprint_of(*prints).alias("record_fingerprint"),
    )
    return merged.select(
        *by, F.when(F.col("k.n") > 0, F.col("k.mean")).alias("mean"), F.when(F.col("k.n") > 0, F.sqrt(F.col("k.m2") / F.col("k.n"))).alias("std"),
        F.col("k.n").alias("n_values"), "record_fingerprint", F.lit("full_record").alias("window"),
        F.lit(f"{TRAIN_FOLDS[0]}-{TRAIN_FOLDS[1]}").alias("folds"), F.lit(1).alias("version"),
    )


def standardise(signals: DataFrame, scaler: DataFrame, on: Sequence[str] = ("fs", "notch", "source")) -> DataFrame:
    """``(x - mean) / std``; a degenerate scaler and a row without one are errors, so no row is lost.

    A scaler table holds one row per rate, notch and source; Spark chooses the join.
    """
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.lit("degenerate scaler")))
    ready = scaler.select(*on, "mean", std.alias("std"))
    known = F.when(F.col("std").isNotNull(), F.col("std")).otherwise(F.raise_error(F.lit("no scaler for a signal")))
    joined = signals.join(ready, list(on), "left").withColumn("std", known)
    scaled = F.transform("samples", lambda x: ((x.cast("double") - F.col("mean")) / F.col("std")).cast("float"))
    return joined.withColumn("samples", scaled).drop("mean", "std")


def resolve_scaler(runs: DataFrame, scalers: DataFrame, expected_fingerprint: DataFrame | None = None,
                   blocking_block: int = 0, fit_fs: int = SOURCE_FS, source: str = "hr") -> DataFrame:
    """Which scaler a run uses and whether a stored one may be reused; one row per run.

    Only scalers of the wanted ``source`` count, unless none of it is stored for a
    rate and notch; two stored for one rate and notch are refused.

    The blocking block fits on its own rate and notch; every other run shares the
    notched source-rate scaler.  A stored scaler is accepted only if source,
    window, folds and, when given, the fingerprint of its records agree.
    """
    own = F.col("block") == blocking_block
    wanted = runs.select(
        "run_id",
        F.when(own, F.col("fs")).otherwise(fit_fs).alias("fit_fs"),
        F.when(own, F.col("notch")).otherwise(F.lit(True)).alias("fit_notch"),
    )
    held = F.struct(F.col("source").alias("s"), F.col("window").alias("w"), F.col("folds").alias("f"), "record_fingerprint", "mean", "std")
    right, any_ = F.col("source").eqNullSafe(source), F.lit(True)

    def only(kind: Column) -> Column:
        one = F.min(F.when(kind, held))
        return F.when(F.count_if(kind) > 1, F.raise_error(F.lit("two scalers for one rate and notch"))).otherwise(one)

    stored = scalers.groupBy(F.col("fs").alias("fit_fs"), F.col("notch").alias("fit_notch")).agg(
        F.when(F.count_if(right) > 0, only(right)).otherwise(only(any_)).alias("k")
    ).select("fit_fs", "fit_notch", "k.*")
    if expected_fingerprint is not None:
        stored = stored.join(
            expected_fingerprint.select(F.col("fs").alias("fit_fs"), F.col("notch").alias("fit_notch"), F.col("fingerprint").alias("want")),
            ["fit_fs", "fit_notch"], "left",
        )
    else:
        stored = stored.withColumn("want", F.col("record_fingerprint"))
    good = (
        (F.col("s") == source) & (F.col("w") == "full_record") & (F.col("f") == f"{TRAIN_FOLDS[0]}-{TRAIN_FOLDS[1]}")
        & F.col("want").eqNullSafe(F.col("record_fingerprint"))
    )
    status = F.when(F.col("s").isNull(), "fit").when(good, "reuse").otherwise("wrong_provenance")
    return wanted.join(stored, ["fit_fs", "fit_notch"], "left").select(
        "run_id", "fit_fs", "fit_notch", status.alias("status"), "mean", "std"
    )


def training_view(signals: DataFrame, labels: DataFrame, scaler: DataFrame, seed: int, epoch: int,
                  record_ds: int = RECORD_DS, width_ds: int = WINDOW_DS) -> DataFrame:
    """Model-ready rows: seeded window, standardised, with the record's label vector (NULL without labels)."""
    target = labels.groupBy("record_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("label", "y"))), lambda s: s["y"]).alias("target")
    )
    windows = standardise(seeded_crop(signals, seed, epoch, record_ds, width_ds), scaler)
    return windows.join(target, "record_id", "left")


# --- spectra ----------------------------------------------------------------------------------------

def _mean_spectrum(signals: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], hz_per_bin: float) -> DataFrame:
    """Mean over leads, then over records; a record with a non-finite lead is left out.

    A task adds up the spectra of its rows, one vector per number of leads; only
    those vectors move.  What rows cannot know, whether another lead of their record is
    bad or missing, comes from the list of records that are not like most, written first, so
    that Spark sees its size and joins accordingly.
    """
    finite = samples_finite("samples")
    leads = written(signals.groupBy("record_id").agg(F.count(F.lit(1)).alias("_leads"), F.min(finite).alias("_ok")), "leads")
    usual = leads.where("_ok").groupBy("_leads").count().orderBy(F.desc("count"), "_leads").first()
    most = usual["_leads"] if usual else 1
    odd = written(leads.where(f"not _ok or _leads <> {most}"), "odd")
    rows = signals.select("record_id", "samples").join(odd, "record_id", "left").where("_ok is null or _ok").select(
        F.coalesce("_leads", F.lit(most)).cast("long").alias("leads"), F.col("samples").cast("array<double>").alias("samples")
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            count = batch.column(0).to_numpy()
            lists = batch.column(1)
            length = lists.value_lengths().to_numpy()
            for n in np.unique(count):
                for m in np.unique(length[count == n]):
                    where = np.flatnonzero((count == n) & (length == m))
                    for lo in range(0, len(where), KERNEL_ROWS):
                        part = lists.take(pa.array(where[lo : lo + KERNEL_ROWS])).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                        power = kernel(part)
                        at = held.setdefault((int(n), power.shape[1]), [0, np.zeros(power.shape[1])])
                        at[0] += len(power)
                        at[1] += power.sum(axis=0)
        for (n, _), (rows_, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([rows_], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["leads", "rows", "total"]
            )

    sums = rows.mapInArrow(add_up, "leads long, rows long, total array<double>")
    per_bin = sums.select("leads", "rows", F.posexplode("total").alias("bin", "p")).groupBy("bin").agg(
        F.sum(F.col("p") / F.col("leads")).alias("s"), F.sum(F.col("rows") / F.col("leads")).alias("n")
    )
    return per_bin.select("bin", (F.col("bin") * hz_per_bin).alias("freq"), (F.col("s") / F.col("n")).alias("power"))


def welch_psd(signals: DataFrame, fs: float = SOURCE_FS, nperseg: int = 1000) -> DataFrame:
    return _mean_spectrum(signals, lambda x: kernels.welch(x, fs, nperseg), fs / nperseg)


def dft_power(signals: DataFrame, fs: float, n_samples: int) -> DataFrame:
    return _mean_spectrum(signals, kernels.dft_power, fs / n_samples)


def trapezoids(psd: DataFrame) -> DataFrame:
    """Area between adjacent bins ``(freq, next_freq, area)``; a spectrum has few bins."""
    w = Window.partitionBy(F.lit(0)).orderBy("freq")
    step = psd.select("freq", "power", F.lead("freq").over(w).alias("next_freq"), F.lead("power").over(w).alias("np"))
    return step.where(F.col("next_freq").isNotNull()).select(
        "freq", "next_freq", ((F.col("next_freq") - F.col("freq")) * (F.col("power") + F.col("np")) / 2).alias("area")
    )


def power_above_nyquist(psd: DataFrame, rates: Sequence[int] = RATES) -> DataFrame:
    """Share of power above each rate's Nyquist frequency, in percent.

    Both ends of an interval must lie above it: the partial first interval is out.
    """
    per = trapezoids(psd).agg(
        F.sum("area").alias("total"),
        *[F.sum(F.when(F.col("freq") > fs / 2, F.col("area")).otherwise(0.0)).alias(f"a{fs}") for fs in rates],
    )
    rows = F.array(*[
        F.struct(F.lit(fs).alias("rate_hz"), F.lit(fs / 2).alias("nyquist_hz"), F.col(f"a{fs}").alias("above"))
        for fs in rates
    ])
    return per.select("total", F.inline(rows)).select(
        "rate_hz", "nyquist_hz", F.bround(100 * F.col("above") / F.col("total"), 4).alias("power_discarded_pct")
    )


def _in_band(lo: float, hi: float) -> Column:
    return (F.col("freq") >= lo) & (F.col("next_freq") <= hi)


# Bands around the mains frequency and its harmonics, and the controls.
MAINS_BANDS = ((45.0, 55.0), (95.0, 105.0), (145.0, 155.0), (195.0, 205.0))
CONTROL_BANDS = ((60.0, 90.0), (110.0, 140.0))


def band_excess(psd: DataFrame, bands: Sequence[tuple[float, float]] = MAINS_BANDS,
                controls: Sequence[tuple[float, float]] = CONTROL_BANDS) -> DataFrame:
    """Share and density of each band, ratio to the control density, verdict."""
    every = [*bands, *controls]
    per = trapezoids(psd).agg(
        F.sum("area").alias("total"),
        *[F.sum(F.when(_in_band(lo, hi), F.col("area")).otherwise(0.0)).alias(f"b{i}") for i, (lo, hi) in enumerate(every)],
    )
    share = lambda i: 100 * F.col(f"b{i}") / F.col("total")
    density = lambda i: share(i) / (every[i][1] - every[i][0])
    control = sum((density(i) for i in range(len(bands), len(every))), F.lit(0.0)) / len(controls)
    rows = F.array(*[
        F.struct(
            F.lit(lo).alias("lo_hz"), F.lit(hi).alias("hi_hz"), F.lit(i >= len(bands)).alias("is_control"),
            share(i).alias("share_pct"), density(i).alias("density"),
        )
        for i, (lo, hi) in enumerate(every)
    ])
    ratio = F.when((F.col("control") > 0) & ~F.col("is_control"), F.col("density") / F.col("control"))
    return per.select(control.alias("control"), F.inline(rows)).withColumn("ratio", ratio).withColumn(
        "verdict",
        F.when(F.col("is_control"), F.lit("control"))
        .when(F.col("ratio") > 3, F.lit("clear_peak"))
        .when(F.col("ratio") > 1.5, F.lit("mild_excess"))
        .otherwise(F.lit("no_excess")),
    )


def harmonic_share(psd: DataFrame, above_hz: float = 50.0,
                   bands: Sequence[tuple[float, float]] = MAINS_BANDS[1:]) -> DataFrame:
    """Share of the power above ``above_hz`` inside the harmonic bands, summed band by band."""
    inside = F.lit(False)
    for lo, hi in bands:
        inside = inside | _in_band(lo, hi)
    return trapezoids(psd).where(F.col("freq") > above_hz).agg(
        F.sum("area").alias("power_above"), F.sum(F.when(inside, F.col("area")).otherwise(0.0)).alias("power_harmonic")
    ).withColumn("harmonic_pct", 100 * F.col("power_harmonic") / F.col("power_above"))


# --- quality -------------------------------------------------------------------------------------------

def raw_checks(signals: DataFrame, n_samples: int, n_leads: int, fs: int) -> DataFrame:
    """Shape, rate and finiteness over all rows (not a probe)."""
    per = signals.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("leads"),
        F.max((F.size("samples") != n_samples).cast("int")).alias("bad_len"),
        F.max((F.col("fs") != fs).cast("int")).alias("bad_fs"),
        F.max((~samples_finite("samples")).cast("int")).alias("bad_value"),
    )
    one = per.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when((F.col("leads") != n_leads) | (F.col("bad_len") == 1), 1)).alias("shape"),
        F.coalesce(F.sum("bad_fs"), F.lit(0)).alias("rate"),
        F.coalesce(F.sum("bad_value"), F.lit(0)).alias("value"),
    )
    return check_rows(one, {
        "records_read": (F.col("n") > 0, F.col("n")),
        "shape": (F.col("shape") == 0, F.col("shape")),
        "rate": (F.col("rate") == 0, F.col("rate")),
        "finite": (F.col("value") == 0, F.col("value")),
    })


def record_peaks(signals: DataFrame) -> DataFrame:
    """Per record: non-finite values, extremes, largest absolute value, flat on every lead."""
    num = F.filter("samples", lambda s: ~F.isnan(s))
    per_lead = signals.select(
        "record_id",
        F.size(F.filter("samples", lambda s: F.isnan(s) | (F.abs(s) == float("inf")))).alias("bad"),
        F.array_min(num).cast("double").alias("lo"),
        F.array_max(num).cast("double").alias("hi"),
        (F.array_max("samples") == F.array_min("samples")).alias("flat"),
    )
    return per_lead.groupBy("record_id").agg(
        F.sum("bad").alias("bad"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.greatest(F.abs(F.min("lo")), F.abs(F.max("hi"))).alias("peak"),
        F.min("flat").alias("flat"),
    )


def signal_profile(signals: DataFrame, thresholds: Sequence[float] = (5, 10, 20, 30), limit: float = 20.0,
                   top: int = 6, cuts: Sequence[float] | None = None) -> DataFrame:
    """Store profile as ``(metric, value)``: quality counts, extremes, peak quantiles, largest peaks."""
    peaks = record_peaks(signals)
    sums = peaks.agg(
        F.count(F.lit(1)).cast("double").alias("n_records"),
        F.sum("bad").cast("double").alias("n_nonfinite"),
        F.count(F.when(F.col("flat"), 1)).cast("double").alias("n_flat"),
        F.min("lo").alias("amplitude_min"),
        F.max("hi").alias("amplitude_max"),
        *[F.count(F.when(F.col("peak") > t, 1)).cast("double").alias(f"n_over_{t}") for t in thresholds],
    )
    names = ["n_records", "n_nonfinite", "n_flat", "amplitude_min", "amplitude_max", *[f"n_over_{t}" for t in thresholds]]
    warn = ((F.col("amplitude_max") > limit) | (F.col("amplitude_min") < -limit)).cast("double")
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]
    pairs.append(F.struct(F.lit("range_warning").alias("metric"), warn.alias("value")))
    rows = sums.select(F.inline(F.array(*pairs)))
    quant = exact_quantiles(peaks, [], "peak", [0.5, 0.99], cuts).select(
        F.when(F.col("p") == 0.5, F.lit("peak_median")).otherwise(F.lit("peak_p99")).alias("metric"),
        F.col("q").alias("value"),
    )
    largest = peaks.orderBy(F.col("peak").desc(), "record_id").limit(top).select(
        F.concat(F.lit("peak_of_"), F.col("record_id").cast("string")).alias("metric"), F.col("peak").alias("value")
    )
    return rows.unionByName(quant).unionByName(largest)


def window_alignment(a: DataFrame, b: DataFrame, a_fs: int, b_fs: int, check_signal: bool = True) -> DataFrame:
    """Whether two window sets differ only by rate.

    One full outer join on ``(record, lead, start)``; mismatched keys, durations and
    notch states are counted, and the higher rate resampled to the lower gives the
    mean correlation (windows without variance left out, 0 when none is left).
    """
    if a_fs == b_fs:
        raise ValueError("the two views have the same rate")
    hi, lo, hi_fs, lo_fs = (a, b, a_fs, b_fs) if a_fs > b_fs else (b, a, b_fs, a_fs)
    keys = ["record_id", "lead", "start_ds"]
    up, down = kernels.rate_factors(hi_fs, lo_fs)
    high = hi.select(*keys, "notch", F.size("samples").alias("n_hi"), "samples")
    if check_signal:
        high = map_samples(high, lambda x: kernels.resample(x, up, down), "double")
    high = high.withColumnsRenamed({"samples": "xs", "notch": "notch_hi"})
    low = lo.select(*keys, F.col("notch").alias("notch_lo"), F.size("samples").alias("n_lo"),
                    F.transform("samples", lambda v: v.cast("double")).alias("ys"))
    both = high.join(low, keys, "full_outer")
    present = F.col("n_hi").isNotNull() & F.col("n_lo").isNotNull()
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    centred = both.withColumns({
        "_mx": total("xs") / F.size("xs"), "_my": total("ys") / F.size("ys"),
    }).withColumns({
        "_x": F.transform("xs", lambda v: v - F.col("_mx")), "_y": F.transform("ys", lambda v: v - F.col("_my")),
    })
    dot = lambda p, q: total(F.zip_with(p, q, lambda u, v: u * v))
    den = F.sqrt(dot("_x", "_x") * dot("_y", "_y"))
    same_size = F.size("xs") == F.size("ys")
    corr = F.when(present & same_size & (den > 0), dot("_x", "_y") / den)
    out = centred.select(
        *keys, present.alias("present"), "n_hi", "n_lo", "notch_hi", "notch_lo", same_size.alias("same_size"),
        (corr if check_signal else F.lit(None).cast("double")).alias("corr"),
    ).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count(F.when(~F.col("present"), 1)).alias("n_unpaired"),
        F.count(F.when(F.col("notch_hi") != F.col("notch_lo"), 1)).alias("n_notch_mismatch"),
        F.count(F.when(F.col("n_hi") * lo_fs != F.col("n_lo") * hi_fs, 1)).alias("n_duration_mismatch"),
        F.count(F.when(~F.col("same_size"), 1)).alias("n_shape_mismatch") if check_signal
        else F.lit(0).cast("bigint").alias("n_shape_mismatch"),
        F.coalesce(F.avg("corr"), F.lit(0.0)).alias("mean_corr"),
    )
    return out


def refuse_misaligned(report: DataFrame, min_corr: float | None = 0.95) -> None:
    """Raise unless an alignment report shows two views of the same signal."""
    r = report.first()
    bad = {k: r[k] for k in ("n_unpaired", "n_notch_mismatch", "n_duration_mismatch", "n_shape_mismatch") if r[k]}
    if bad:
        raise ValueError(f"views are not aligned: {bad}")
    if min_corr is not None and r["mean_corr"] < min_corr:
        raise ValueError(f"mean correlation {r['mean_corr']:.4f} is below {min_corr}")


def compare_stored(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Recomputed rows against stored ones; the largest difference must be exactly 0."""
    keys = ["record_id", "lead"]
    joined = stored.select(*keys, F.col("samples").alias("s")).join(
        fresh.select(*keys, F.col("samples").alias("f")), keys, "full_outer"
    )
    gap = F.when(
        F.size("s") == F.size("f"), F.array_max(F.zip_with("s", "f", lambda p, q: F.abs(p.cast("double") - q.cast("double"))))
    )
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(gap.isNull(), 1)).alias("n_incomparable"),
        F.max(gap).alias("max_abs_diff"),
    )
