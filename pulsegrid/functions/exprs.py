"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F, types as T

#: Hex digits of md5 used for a draw: 60 bits always fit a BIGINT.
DRAW_HEX = 15


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def hash60(*parts, offset: int = 0) -> Column:
    """60-bit integer from the md5 of ``a:b:c``; portable to any SQL engine."""
    text = F.concat_ws(":", *[as_col(p).cast("string") for p in parts])
    return hex60(F.md5(text), offset)


def hex60(digest: Column, offset: int = 0) -> Column:
    piece = F.substring(digest, 1 + offset, DRAW_HEX)
    return F.conv(piece, 16, 10).cast("bigint")


def hash_draw(modulo, *parts) -> Column:
    """Deterministic draw from ``0..modulo-1``."""
    return F.pmod(hash60(*parts), as_col(modulo).cast("bigint"))


def epoch_seed(seed, epoch) -> Column:
    """Seed of an epoch in ``1..2**31-2``; the same in every process and on resume."""
    s, e = (F.lit(v) if isinstance(v, int) else as_col(v) for v in (seed, epoch))
    return hash_draw(2**31 - 2, s, e) + 1


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def fingerprint_parts(*key) -> dict[str, tuple[Column, T.DataType]]:
    """Per row, what a set fingerprint is made of, and the types of the merged parts: two pieces of the key's md5."""
    digest = F.md5(F.concat_ws(":", *[as_col(k).cast("string") for k in key]))
    return {
        "_count": (F.lit(1).cast("bigint"), T.LongType()),
        "_first": (hex60(digest, 0), T.LongType()),
        "_second": (hex60(digest, 15), T.LongType()),
        "_total": (hex60(digest, 0).cast("decimal(38,0)"), T.DecimalType(38, 0)),
    }


def fingerprint_start() -> list:
    return [0, 0, 0, Decimal(0)]


def fingerprint_merge(left: list, right: list) -> list:
    """Parts of two disjoint sets together."""
    return [left[0] + right[0], left[1] ^ right[1], left[2] ^ right[2], left[3] + right[3]]


def fingerprint_of(count: str, first: str, second: str, total: str) -> Column:
    """Aggregate: 16 hex digits from parts that were merged before."""
    payload = F.concat_ws(
        ":",
        F.coalesce(F.sum(count), F.lit(0)).cast("string"),
        F.coalesce(F.bit_xor(first), F.lit(0)).cast("string"),
        F.coalesce(F.bit_xor(second), F.lit(0)).cast("string"),
        F.coalesce(F.sum(F.col(total).cast("decimal(38,0)")), F.lit(0)).cast("string"),
    )
    return F.substring(F.sha2(payload, 256), 1, 16)


def set_fingerprint(*key) -> Column:
    """Aggregate: 16 hex digits that identify a *set* of unique keys.

    Two xors and a sum of md5 pieces merge in any order, so the map side
    combines them and no task ever holds the list of ids.
    """
    digest = F.md5(F.concat_ws(":", *[as_col(k).cast("string") for k in key]))
    payload = F.concat_ws(
        ":",
        F.count(F.lit(1)).cast("string"),
        F.coalesce(F.bit_xor(hex60(digest, 0)), F.lit(0)).cast("string"),
        F.coalesce(F.bit_xor(hex60(digest, 15)), F.lit(0)).cast("string"),
        F.coalesce(F.sum(hex60(digest, 0).cast("decimal(20,0)")), F.lit(0)).cast("string"),
    )
    return F.substring(F.sha2(payload, 256), 1, 16)


def is_finite(x) -> Column:
    c = as_col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def samples_finite(samples) -> Column:
    """True when an array holds no NULL, NaN or infinity."""
    return F.forall(as_col(samples), lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))


def require(condition: Column, message, value: Column) -> Column:
    """``value`` where ``condition`` holds, otherwise the query fails with ``message``."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(condition, value).otherwise(F.raise_error(text))


# --- time: integer deciseconds ------------------------------------------------

def decisecond_index(start_ms, fs) -> Column:
    """Sample index of an instant given in milliseconds.

    The 0.1 s grid is tested first and is the stronger condition; only then must
    the index be whole at ``fs``.
    """
    ms, rate = as_col(start_ms).cast("bigint"), as_col(fs).cast("bigint")
    ds = F.floor(ms / 100).cast("bigint")
    return (
        F.when(F.pmod(ms, F.lit(100)) != 0, F.raise_error(F.lit("start is off the 0.1 s grid")))
        .when(F.pmod(ds * rate, F.lit(10)) != 0, F.raise_error(F.lit("start is not a whole sample")))
        .otherwise((ds * rate / 10).cast("bigint"))
    )


def grid_status(start_ms, fs) -> Column:
    """The same two tests as :func:`decisecond_index`, reported instead of raised."""
    ms, rate = as_col(start_ms).cast("bigint"), as_col(fs).cast("bigint")
    return (
        F.when(F.pmod(ms, F.lit(100)) != 0, F.lit("off_grid"))
        .when(F.pmod(ms * rate, F.lit(1000)) != 0, F.lit("off_sample"))
        .otherwise(F.lit("ok"))
    )


def whole_samples(deciseconds: int, fs: int) -> int:
    """Samples in a span at ``fs``; an error when the count is not whole."""
    if (deciseconds * fs) % 10:
        raise ValueError(f"{deciseconds / 10} s is not a whole number of samples at {fs} Hz")
    return deciseconds * fs // 10


# --- run identity ---------------------------------------------------------------

def run_label(block, fs, arm, notch, seed) -> Column:
    return F.format_string(
        "b%s-fs%s-%s-n%s-s%s",
        as_col(block).cast("string"), as_col(fs).cast("string"), as_col(arm),
        as_col(notch).cast("int").cast("string"), as_col(seed).cast("string"),
    )
