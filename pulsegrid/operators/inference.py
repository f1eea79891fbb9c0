"""Shared-resample bootstrap, intervals, p-values and family corrections."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import is_finite
from ..session import written
from .prefix import RANGE, Layout, dense_index, lookup_join, range_cuts, range_layout, running, running_max, with_range
from .ranking import accuracy_at, auroc, auroc_from_counts, ensemble, label_scores, mark_frozen

#: Cells of a run, label and score range that travel as one row.
CELLS_PER_PIECE = 32_768
#: Bytes of weights a task may hold: one per record and replicate of its block.
WEIGHTS_PER_TASK = 1 << 27
#: Weights evaluated or opened at once inside a task.
WEIGHTS_AT_ONCE = 1 << 21
#: Digests made at once; each gives two draws.
DIGESTS_AT_ONCE = 1 << 18
#: Records whose keys travel as one row.
RECORDS_PER_ROW = 4_096
#: The replicate that holds every record once.
POINT = -1


# --- L2: one resample for every run and group ----------------------------------------

def replicate_weights(n: int, reps: Sequence[int], seed: int = 0) -> np.ndarray:
    """``(record, replicate)``: how often each of ``n`` positions is drawn in ``n`` draws with replacement.

    A draw is a function of ``(seed, rep, slot)`` alone, so a task that owns a
    replicate makes its draws by itself; one md5 gives two.
    """
    weights = np.zeros((n, len(reps)), dtype=np.uint8)
    md5 = partial(hashlib.md5, usedforsecurity=False)
    half = (n + 1) // 2
    for lo in range(0, half, DIGESTS_AT_ONCE):
        slots = [b"%d" % h for h in range(lo, min(lo + DIGESTS_AT_ONCE, half))]
        for j, rep in enumerate(reps):
            name = b"%d:%d:" % (seed, rep)
            high, low = np.frombuffer(b"".join([md5(name + s).digest() for s in slots]), ">u8").astype(np.uint64).reshape(-1, 2).T
            # hex digits 0-14 and 15-29
            pair = np.stack([high >> 4, (high & 15) << 56 | low >> 8], axis=1).reshape(-1)[: n - 2 * lo]
            at, times = np.unique((pair % np.uint64(n)).astype(np.int64), return_counts=True)
            weights[at, j] += times.astype(np.uint8)
    if n and (weights.sum(axis=0, dtype=np.int64) != n).any():
        raise OverflowError("a record was drawn more than 255 times")
    return weights


def block_width(spark: SparkSession, n: int, n_boot: int) -> int:
    """Replicates of a block: every core gets a task, and the weights of a block fit one."""
    return max(1, min(-(-n_boot // (2 * spark.sparkContext.defaultParallelism)), WEIGHTS_PER_TASK // max(1, n)))


def bootstrap_weights(records: DataFrame, n_boot: int, seed: int = 0, key: str = "record_id") -> DataFrame:
    """``(rep, key, w)`` over the distinct records; positions follow the order of the key.

    Keys are written once, ``RECORDS_PER_ROW`` to a row.  One task per block of
    replicates makes its weights and reads the keys past them, so no weight is
    shuffled or broadcast.
    """
    spark = records.sparkSession
    ids = written(records.select(key).distinct(), "records")
    n = ids.count()
    width = block_width(spark, n, n_boot)
    keys = dense_index(ids, key).groupBy(F.expr(f"idx div {RECORDS_PER_ROW}").alias("place")).agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col(key).alias("k")))).alias("held")  # RECORDS_PER_ROW at most
    ).select((F.col("place") * RECORDS_PER_ROW).alias("first"), F.col("held.k").alias("k"))
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField(key, ids.schema[key].dataType), T.StructField("w", T.LongType())])
    arrow = to_arrow_schema(schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = weights = None
        for batch in batches:
            for block, first, held in zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("k")):
                if block != at:
                    weights = None  # the last block's go first
                    at, weights = block, replicate_weights(n, range(block * width, min((block + 1) * width, n_boot)), seed)
                drawn = weights[first : first + len(held.values)].T
                step = max(1, WEIGHTS_AT_ONCE // len(held.values))
                for lo in range(0, len(drawn), step):
                    w = np.ascontiguousarray(drawn[lo : lo + step])
                    rep, place = np.nonzero(w)
                    columns = [pa.array(block * width + lo + rep), held.values.take(pa.array(place)), pa.array(w[rep, place].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return _per_block(written(keys, "keys"), -(-n_boot // width)).mapInArrow(opened, schema)


def _per_block(pieces: DataFrame, n_blocks: int) -> DataFrame:
    """Written ``pieces`` for every ``block``, one task each, which reads them where they are written; no copy of them is shuffled."""
    spark = pieces.sparkSession
    numbers = spark.sparkContext.parallelize(range(n_blocks), n_blocks).map(lambda number: (number,))
    blocks = spark.createDataFrame(numbers, "block int")
    return pieces.coalesce(1).crossJoin(blocks.hint("shuffle_replicate_nl"))


# --- draws of the rank statistics --------------------------------------------------------

class Resample(NamedTuple):
    """Predictions in written pieces: the cells of a run and label in one score range, in the order of their scores."""

    pieces: DataFrame
    runs: DataFrame
    by: tuple[str, ...]
    label: T.StructField
    n: int
    n_boot: int
    seed: int
    width: int


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """One row of a group: record numbers by score, four bytes each, then a bit for the positives and one for each new score."""
    score = table["score"].to_numpy()
    order = np.argsort(score, kind="stable")
    score = score[order]
    positive = table["y"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[order]
    body = {"idx": table["idx"].to_numpy()[order].astype(np.int32), "positive": np.packbits(positive), "new": np.packbits(np.append(True, np.diff(score) != 0))}
    return pa.table(
        {c: pa.array([k.as_py()], k.type) for c, k in zip(("label", "_run", RANGE), key)}
        | {c: pa.array([v.tobytes()], pa.binary()) for c, v in body.items()}
    )


def resample(preds: DataFrame, by: Sequence[str], n_boot: int, seed: int = 0, cuts: Sequence[float] | None = None) -> Resample:
    """The shared resample over ``(by…, record_id, label, y, score)``, one form for all sizes.

    Draws need no table, so weights never move: a task makes those of its block of
    replicates and reads the predictions past them.  Predictions are written once,
    at a little over four bytes each, and every block reads that one table, so
    what is on disk does not depend on the number of blocks.  There are twice as many of them as
    cores unless a block's weights outgrow ``WEIGHTS_PER_TASK``.  Score ranges keep a
    piece to about ``CELLS_PER_PIECE`` cells; ``cuts`` steer balance only and come from
    a sketch of the scores unless given.  A NULL or NaN score is refused.  Records may
    have keys of any orderable type.
    """
    spark = preds.sparkSession
    by = tuple(by)
    known = F.when(F.col("score").isNull() | F.isnan("score"), F.raise_error(F.lit("a score is undefined"))).otherwise(F.col("score"))
    cells = written(preds.select("record_id", "label", *by, (F.col("y") > 0).alias("y"), known.cast("double").alias("score")), "cells")
    ids = cells.select("record_id").where("record_id is not null").distinct()
    n = ids.count()
    if not n:
        raise ValueError("no predictions to resample")
    if cuts is None:
        ranges = -(-n // CELLS_PER_PIECE)
        cuts = range_cuts(cells, "score", rows_per_range=max(1, cells.count() // ranges)) if ranges > 1 else ()
    # as many rows as there are runs
    runs = cells.select(*by).distinct().withColumn("_run", F.row_number().over(Window.orderBy(*by or [F.lit(0)])) - 1)
    same = [cells[c].eqNullSafe(runs[c]) for c in by]
    named = (cells.join(runs, same) if by else cells.crossJoin(runs)).select("record_id", "label", "_run", "y", "score")
    named = with_range(named, "score", cuts) if cuts else named.withColumn(RANGE, F.lit(0))
    numbered = dense_index(ids, "record_id").select("record_id", F.col("idx").cast("int").alias("idx"))
    label = T.StructField("label", preds.schema["label"].dataType)
    schema = T.StructType([
        label, T.StructField("_run", T.IntegerType()), T.StructField(RANGE, T.IntegerType()),
        *[T.StructField(c, T.BinaryType()) for c in ("idx", "positive", "new")],
    ])
    pieces = named.join(numbered, "record_id").select("label", "_run", RANGE, "idx", "y", "score").groupBy("label", "_run", RANGE).applyInArrow(_pack, schema)
    return Resample(written(pieces, "pieces"), runs, by, label, n, n_boot, seed, block_width(spark, n, n_boot))


def _summed(w: np.ndarray) -> np.ndarray:
    """Running totals of the rows, none first."""
    out = np.zeros((len(w) + 1, w.shape[1]), dtype=np.int64)
    np.cumsum(w, axis=0, out=out[1:])
    return out


def _replicates(sample: Resample, columns: Sequence[str], kernel: Callable, point: bool) -> DataFrame:
    """``(label, _run, rep, n_pos, n_neg, columns…)``: sums over the pieces of each run and label, highest scores first.

    One task per block, which reads all pieces from where they are written; no copy of them is shuffled.
    ``kernel(w, positive, rank, n_pos, n_neg)`` gives one array of replicates per
    column, class totals first; ``n_pos`` and ``n_neg`` are the totals of the higher pieces.
    """
    kinds = {"long": (np.int64, T.LongType()), "double": (np.float64, T.DoubleType())}
    named = [c.split() for c in ("n_pos long", "n_neg long", *columns)]
    schema = T.StructType([
        sample.label, T.StructField("_run", T.IntegerType()), T.StructField("rep", T.LongType()),
        *[T.StructField(c, kinds[k][1]) for c, k in named],
    ])
    arrow = to_arrow_schema(schema)
    n, n_boot, seed, width = sample.n, sample.n_boot, sample.seed, sample.width

    def block(number: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's replicates and their weights, in the first one also the one that holds every record once."""
        reps = np.arange(number * width, min((number + 1) * width, n_boot))
        weights = replicate_weights(n, reps.tolist(), seed)
        if point and number == 0:
            return np.append(reps, POINT), np.append(weights, np.ones((n, 1), np.uint8), axis=1)
        return reps, weights

    def rows(key: tuple, reps: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        _, label, run = key
        values = [[label] * len(reps), [run] * len(reps), reps, *sums]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = reps = weights = sums = None
        for batch in batches:
            body = {c: batch.column(c) for c in ("idx", "positive", "new")}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "label", "_run")))):
                if key != at:
                    if at is not None:
                        yield rows(at, reps, sums)
                    if at is None or at[0] != key[0]:
                        weights = None  # the last block's go first
                        reps, weights = block(key[0])
                    at, sums = key, [np.zeros(len(reps), dtype=kinds[k][0]) for _, k in named]
                idx = np.frombuffer(body["idx"][i].as_buffer(), np.int32)
                bits = lambda c: np.unpackbits(np.frombuffer(body[c][i].as_buffer(), np.uint8), count=len(idx))  # noqa: B023, E731
                positive, rank = bits("positive").astype(bool), np.cumsum(bits("new"))
                drawn = weights[idx]
                step = max(1, WEIGHTS_AT_ONCE // len(idx))
                for lo in range(0, len(reps), step):
                    to = slice(lo, lo + step)
                    for total, made in zip(sums, kernel(drawn[:, to].astype(np.int64), positive, rank, sums[0][to].copy(), sums[1][to].copy())):
                        total[to] += made
        if at is not None:
            yield rows(at, reps, sums)

    return _per_block(sample.pieces, -(-n_boot // width)).sortWithinPartitions("block", "label", "_run", F.desc(RANGE)).mapInArrow(evaluate, schema)


def _named(sample: Resample, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    return values.join(sample.runs, "_run").select("rep", *sample.by, *columns)


def _totals(w, positive, rank, above_pos, above_neg):
    return w[positive].sum(axis=0), w[~positive].sum(axis=0)


def _pairs(w, positive, rank, above_pos, above_neg):
    """Positives, negatives and twice the Mann-Whitney count in each replicate."""
    below = _summed(w[~positive])
    wp = w[positive]
    high, low = rank[positive], rank[~positive]
    wins = below[np.searchsorted(low, high, "left")] + below[np.searchsorted(low, high, "right")]
    return wp.sum(axis=0), below[-1], np.einsum("ij,ij->j", wp, wins) + 2 * above_pos * below[-1]


def bootstrap_counts(
    preds: DataFrame, by: Sequence[str], n_boot: int, seed: int = 0, cuts: Sequence[float] | None = None, point: bool = False,
) -> DataFrame:
    """``(rep, by…, label, n_pos, n_neg, u2)`` for every replicate; see :func:`resample`.

    Pairs inside a piece are counted there; pairs across pieces are the negatives of
    a piece times the positives of the higher ones.  With ``point``, a replicate -1
    holds every record once.
    """
    sample = resample(preds, by, n_boot, seed, cuts)
    return _named(sample, _replicates(sample, ("u2 long",), _pairs, point), ["label", "n_pos", "n_neg", "u2"])


def _precision(w, positive, rank, above_pos, above_neg):
    """Class totals, and the sum over the positives of a piece of weight times precision at their score."""
    high, low = rank[positive], rank[~positive]
    wp = w[positive]
    lower_p, lower_n = _summed(wp), _summed(w[~positive])
    tp = above_pos + lower_p[-1] - lower_p[np.searchsorted(high, high, "left")]
    fp = above_neg + lower_n[-1] - lower_n[np.searchsorted(low, high, "left")]
    return lower_p[-1], lower_n[-1], np.where(wp > 0, wp * tp / np.maximum(tp + fp, 1), 0.0).sum(axis=0)


def bootstrap_precision(
    preds: DataFrame, by: Sequence[str], n_boot: int, seed: int = 0, cuts: Sequence[float] | None = None, point: bool = False,
) -> DataFrame:
    """``(rep, by…, label, n_pos, n_neg, auprc)``: average precision of every replicate, NULL unless both classes are drawn."""
    sample = resample(preds, by, n_boot, seed, cuts)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    scored = _replicates(sample, ("step double",), _precision, point).withColumn("auprc", F.when(both, F.col("step") / F.col("n_pos")))
    return _named(sample, scored, ["label", "n_pos", "n_neg", "auprc"])


def bootstrap_accuracy(
    preds: DataFrame, by: Sequence[str], n_boot: int, seed: int = 0, cuts: Sequence[float] | None = None, point: bool = False,
    threshold: float = 0.5,
) -> DataFrame:
    """``(rep, by…, right, total, accuracy)`` over all labels: the drawn share of the cells that are right."""
    right = (F.col("score").cast("double") >= threshold) == F.coalesce(F.col("y") > 0, F.lit(False))
    sample = resample(preds.withColumn("y", right.cast("int")), by, n_boot, seed, cuts)
    sums = _replicates(sample, (), _totals, point).groupBy("_run", "rep").agg(
        F.sum("n_pos").alias("right"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("total")
    )
    return _named(sample, sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("right") / F.col("total"))), ["right", "total", "accuracy"])


def macro_draws(counts: DataFrame, by: Sequence[str], frozen: DataFrame | None = None) -> DataFrame:
    """Macro AUROC per replicate, labels undefined in a replicate left out.

    Long form ``(rep, by…, endpoint, value, n_defined)``.
    """
    scored = counts.withColumn("auroc", auroc_from_counts(F.col("u2"), F.col("n_pos"), F.col("n_neg")))
    return endpoint_values(scored, ["rep", *by], frozen)


def endpoint_values(scored: DataFrame, by: Sequence[str], frozen: DataFrame | None = None) -> DataFrame:
    """``(by…, endpoint, value, n_defined)`` for all labels and, if given, the frozen ones."""
    if frozen is not None:
        scored = mark_frozen(scored, frozen)
        kept = F.when(F.col("frozen"), F.col("auroc"))
    else:
        kept = F.col("auroc")
    cols = [F.avg("auroc").alias("_all"), F.count("auroc").alias("_n_all")]
    pairs = [F.struct(F.lit("macro_all").alias("endpoint"), F.col("_all").alias("value"), F.col("_n_all").alias("n_defined"))]
    if frozen is not None:
        cols += [F.avg(kept).alias("_clean"), F.count(kept).alias("_n_clean")]
        pairs.append(F.struct(
            F.lit("macro_clean").alias("endpoint"), F.col("_clean").alias("value"), F.col("_n_clean").alias("n_defined")
        ))
    return scored.groupBy(*by).agg(*cols).select(*by, F.inline(F.array(*pairs)))


# --- L5, L6, L8: summaries of draws ------------------------------------------------------

def _quantile(sorted_values: Column, p: Column) -> Column:
    pos = (F.size(sorted_values) - 1) * p
    low = F.floor(pos).cast("int")
    a = F.element_at(sorted_values, low + 1)
    b = F.element_at(sorted_values, F.least(low + 2, F.size(sorted_values)))
    return a + (b - a) * (pos - low)


def draw_summary(draws: DataFrame, by: Sequence[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    """Percentile interval and two-sided add-one p-value of each group of draws.

    Undefined draws are dropped and counted; a group without a defined draw is an
    error.  ``sorted_draws`` (at most one value per replicate) stays for intervals
    at other levels.
    """
    v = F.when(is_finite(value), F.col(value))
    got = draws.groupBy(*by).agg(
        F.sort_array(F.collect_list(v)).alias("sorted_draws"),
        F.count(F.lit(1)).alias("n_draws"),
        F.count(v).alias("n_defined"),
        F.count(F.when(v <= 0, 1)).alias("_le"),
        F.count(F.when(v >= 0, 1)).alias("_ge"),
    )
    values = F.when(
        F.col("n_defined") == 0, F.raise_error(F.lit("all bootstrap replicates are undefined"))
    ).otherwise(F.col("sorted_draws"))
    smaller = F.least(F.col("_le"), F.col("_ge")) + 1
    return got.withColumn("sorted_draws", values).select(
        *by, "sorted_draws", "n_draws", "n_defined",
        _quantile(F.col("sorted_draws"), F.lit(alpha / 2)).alias("lo"),
        _quantile(F.col("sorted_draws"), F.lit(1 - alpha / 2)).alias("hi"),
        F.least(F.lit(1.0), F.lit(2.0) * smaller / (F.col("n_defined") + 1)).alias("p_raw"),
    )


def percentile_ci(draws: DataFrame, by: Sequence[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    return draw_summary(draws, by, value, alpha).select(*by, "n_defined", "lo", "hi")


def bootstrap_p(draws: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return draw_summary(draws, by, value).select(*by, "n_defined", "p_raw")


def holm(df: DataFrame, family: Sequence[str], p: str = "p_raw", cuts: Sequence[float] | None = None,
         name: str = "p_holm") -> DataFrame:
    """Holm step-down adjustment inside each family, families of any size.

    Equal p-values share an adjusted value.  Without cuts (small families) one
    pass of windows does it; with cuts distinct values are scanned by range.  A
    NULL or NaN p is no test: it stays, adjusted to NULL, and does not count.
    """
    family = list(family)
    tested = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    untested = df.where(~F.coalesce(tested, F.lit(False))).withColumn(name, F.lit(None).cast("double"))
    df = df.where(tested)
    return _holm(df, family, p, range_cuts(df, p) if cuts is None else cuts, name).unionByName(untested)


def _holm(df: DataFrame, family: list[str], p: str, cuts: Sequence[float], name: str) -> DataFrame:
    if not cuts:
        whole, by_p = Window.partitionBy(*family), Window.partitionBy(*family).orderBy(p)
        left = F.count(F.lit(1)).over(whole) - F.rank().over(by_p) + 1
        top = F.max("_s").over(by_p.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn("_s", left * F.col(p)).withColumn(name, F.least(F.lit(1.0), top)).drop("_s")
    steps = running(df.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")), family, p, ["_n"], cuts, totals=True)
    scaled = steps.withColumn("_s", (F.col("all__n") - F.col("before__n")) * F.col(p))
    top = running_max(scaled.select(*family, p, "_s", "_n"), family, p, "_s", cuts, "_top")
    adjusted = top.select(*family, p, "_n", F.least(F.lit(1.0), F.col("_top")).alias(name))
    return lookup_join(df, adjusted, [*family, p], "_n").drop("_n")


def simultaneous(summary: DataFrame, family: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Bonferroni-simultaneous interval at ``alpha / m`` from the draws already there."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    tail = F.lit(alpha) / F.col("m") / 2
    return summary.withColumn("m", size).withColumn(
        "lo_simultaneous", _quantile(F.col("sorted_draws"), tail)
    ).withColumn("hi_simultaneous", _quantile(F.col("sorted_draws"), F.lit(1.0) - tail))


# --- C9, L4, L10: comparisons ---------------------------------------------------------------

def group_pairs(df: DataFrame, by: Sequence[str], group: str = "grp", value: str = "value") -> DataFrame:
    """``(by…, a, b, value)``: differences between the groups present in each row set.

    The list holds one value per compared group, so a handful, never rows of data.
    """
    g = F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))))
    every = F.flatten(F.transform("gs", lambda x, i: F.transform(
        F.slice("gs", i + 2, F.size("gs")),
        lambda z: F.struct(x["g"].alias("a"), z["g"].alias("b"), (x["v"] - z["v"]).alias("value")),
    )))
    return df.groupBy(*by).agg(g.alias("gs")).select(*by, F.inline(every))


def group_draws(
    preds: DataFrame, frozen: DataFrame | None = None, n_boot: int = 10_000, seed: int = 0, group: str = "grp", family: Sequence[str] = (),
) -> DataFrame:
    """``(rep, family…, grp, endpoint, value, n_defined)`` on the ensembles of the groups, written once.

    Replicate -1 is the point estimate, from the same pass.
    """
    return draws_of(ensemble(preds, group, family), [*family, group], frozen, n_boot, seed)


def draws_of(cells: DataFrame, keys: Sequence[str], frozen: DataFrame | None, n_boot: int, seed: int = 0) -> DataFrame:
    """:func:`group_draws` of ensembles that are already there."""
    return written(macro_draws(bootstrap_counts(cells, keys, n_boot, seed, point=True), keys, frozen), "draws")


def compare_draws(draws: DataFrame, family: Sequence[str] = (), alpha: float = 0.05, group: str = "grp") -> DataFrame:
    """All pairs of groups from :func:`group_draws`, one row per family, endpoint and pair."""
    scope = [*family, "endpoint"]
    diffs = group_pairs(draws, ["rep", *scope], group)
    points = diffs.where(F.col("rep") == POINT).select(*scope, "a", "b", F.col("value").alias("diff"))
    summary = simultaneous(draw_summary(diffs.where(F.col("rep") >= 0), [*scope, "a", "b"], alpha=alpha), scope, alpha)
    adjusted = holm(summary.drop("sorted_draws"), scope, cuts=())
    return adjusted.join(points, [*scope, "a", "b"]).select(
        *scope, "a", "b", "diff", "lo", "hi", "p_raw", "p_holm", "lo_simultaneous", "hi_simultaneous",
        "n_defined", crosses_zero().alias("crosses_zero"), (F.col("p_holm") < 0.05).alias("significant"),
    )


def describe_draws(draws: DataFrame, family: Sequence[str] = (), alpha: float = 0.05, group: str = "grp") -> DataFrame:
    """Point and interval per group and endpoint from :func:`group_draws`."""
    keys = [*family, group, "endpoint"]
    points = draws.where(F.col("rep") == POINT).select(*keys, F.col("value").alias("point"))
    return percentile_ci(draws.where(F.col("rep") >= 0), keys, alpha=alpha).join(points, keys).select(*keys, "point", "lo", "hi", "n_defined")


def compare_groups(
    preds: DataFrame, frozen: DataFrame | None = None, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05,
    group: str = "grp", family: Sequence[str] = (),
) -> DataFrame:
    """All pairs of groups on their ensembles, one resample for all of them.

    One row per family, endpoint and pair: point difference, percentile interval,
    raw and Holm p, simultaneous interval, and the two flags.  Several families
    over the same records go through in one pass; corrections stay inside each.
    """
    return compare_draws(group_draws(preds, frozen, n_boot, seed, group, family), family, alpha, group)


def crosses_zero() -> Column:
    return (F.col("lo") <= 0) & (F.col("hi") >= 0)


def group_results(
    preds: DataFrame, frozen: DataFrame | None = None, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05,
    group: str = "grp", family: Sequence[str] = (),
) -> DataFrame:
    """Ensemble point and interval per group and endpoint."""
    return describe_draws(group_draws(preds, frozen, n_boot, seed, group, family), family, alpha, group)


#: ``metric(df, keys, weight, layout) -> (keys…, value)``.
Metric = Callable[[DataFrame, Sequence[str], str | None, Layout], DataFrame]


def bootstrap_metric(preds: DataFrame, metric: Metric, by: Sequence[str], n_boot: int, seed: int = 0,
                     layout: Layout | None = None) -> DataFrame:
    """``(rep, by…, value)``: draws of any metric on the shared resample; replicate -1 is the point estimate.

    Macro AUROC, macro average precision and accuracy come from states per score
    range.  Any other metric sees one row per prediction and replicate; a replicate reweights
    the same scores, so the layout of the plain predictions serves all of them.
    """
    by = list(by)
    cuts = None if layout is None else layout.cuts
    if metric is macro_auroc_metric:
        return macro_draws(bootstrap_counts(preds, by, n_boot, seed, cuts, point=True), by).select("rep", *by, "value")
    if metric is macro_auprc_metric:
        return bootstrap_precision(preds, by, n_boot, seed, cuts, point=True).groupBy("rep", *by).agg(F.avg("auprc").alias("value"))
    if metric is accuracy_metric:
        return bootstrap_accuracy(preds, by, n_boot, seed, cuts, point=True).select("rep", *by, F.col("accuracy").alias("value"))
    layout = range_layout(preds, "score") if layout is None else layout
    weighted = bootstrap_weights(preds, n_boot, seed).join(preds, "record_id")
    point = metric(preds, by, None, layout).select(F.lit(POINT).cast("long").alias("rep"), *by, "value")
    return metric(weighted, ["rep", *by], "w", layout).select("rep", *by, "value").unionByName(point)


def bootstrap_ci(preds: DataFrame, metric: Metric, by: Sequence[str], n_boot: int = 2_000, seed: int = 0,
                 alpha: float = 0.05, layout: Layout | None = None) -> DataFrame:
    """Point and percentile interval of one metric per model."""
    draws = written(bootstrap_metric(preds, metric, by, n_boot, seed, layout), "draws")
    point = draws.where(F.col("rep") == POINT).select(*by, F.col("value").alias("point"))
    return point.join(percentile_ci(draws.where(F.col("rep") >= 0), by, alpha=alpha), list(by))


def paired_bootstrap(preds: DataFrame, metric: Metric, n_boot: int = 2_000, seed: int = 0, alpha: float = 0.05,
                     group: str = "grp", layout: Layout | None = None) -> DataFrame:
    """Paired differences of one metric between models scored on the same records."""
    diffs = group_pairs(written(bootstrap_metric(preds, metric, [group], n_boot, seed, layout), "draws"), ["rep"], group)
    point = diffs.where(F.col("rep") == POINT).select("a", "b", F.col("value").alias("diff"))
    summary = draw_summary(diffs.where(F.col("rep") >= 0), ["a", "b"], alpha=alpha)
    return summary.join(point, ["a", "b"]).select(
        "a", "b", "diff", "lo", "hi", F.col("p_raw").alias("p_value"), crosses_zero().alias("crosses_zero")
    )


def macro_auroc_metric(df: DataFrame, keys: Sequence[str], weight: str | None, layout: Layout) -> DataFrame:
    return auroc(df, [*keys, "label"], weight, layout.cuts, layout.repeats).groupBy(*keys).agg(F.avg("auroc").alias("value"))


def macro_auprc_metric(df: DataFrame, keys: Sequence[str], weight: str | None, layout: Layout) -> DataFrame:
    return label_scores(df, [*keys, "label"], weight, layout.cuts).groupBy(*keys).agg(F.avg("auprc").alias("value"))


def accuracy_metric(df: DataFrame, keys: Sequence[str], weight: str | None, layout: Layout) -> DataFrame:
    return accuracy_at(df, keys, weight).withColumnRenamed("accuracy", "value")


# --- L9: seed means ------------------------------------------------------------------------

def seed_mean(
    preds: DataFrame, frozen: DataFrame | None = None, n_boot: int = 10_000, seed: int = 0, alpha: float = 0.05,
    group: str = "grp",
) -> DataFrame:
    """Mean of *metrics* over the seeds of a group with a record-level interval.

    The spread between seeds is reported beside the interval, never inside it.
    """
    keys = [group, "run_id"]
    draws = written(macro_draws(bootstrap_counts(preds, keys, n_boot, seed, point=True), keys, frozen), "draws")
    points = draws.where(F.col("rep") == POINT).groupBy(group, "endpoint").agg(
        F.avg("value").alias("point"),
        F.count("value").alias("n_seeds"),
        (F.max("value") - F.min("value")).alias("seed_spread"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("seed_std"),
    )
    means = draws.where(F.col("rep") >= 0).groupBy("rep", group, "endpoint").agg(F.avg("value").alias("value"))
    return points.join(percentile_ci(means, [group, "endpoint"], alpha=alpha), [group, "endpoint"])
