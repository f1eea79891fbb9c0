"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A document becomes its token ids and a closing id 0; only documents longer than
``capacity`` are cut, into pieces of exactly ``capacity`` behind a first piece
that takes the remainder.  Which piece goes where depends on lengths alone, so
packing works on the histogram of lengths: at most ``capacity`` numbers, whatever
the corpus size.

* *Reduction.*  For the longest lengths first, a set of one to three pieces that
  dominates every other set with that length (an exact complement; the largest
  partner where no two fit; a dominating pair) is fixed for as many pieces as
  there are.  Fixing dominating sets cannot cost a sequence.
* *Best fit.*  What is left is placed by decreasing length into the open
  sequences with the least room, whole groups of equal sequences at a time.

The plan is a short list of runs.  The cluster numbers the pieces of each length
(salted, so a length that a third of all pieces share is spread) and every task
looks its pieces' numbers up in the runs.

Edge cases: null and empty texts are the closing id alone.  Repeated rows are
packed as documents of their own, also under one id or a null id.  An empty table gives
an empty result.  Very long texts are tokenised whole.  Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .rows import table, written

CAPACITY = 2048
END_ID = 0
SALTS = 64
BATCH_PIECES = 2048

Bins = list[tuple[int, tuple[tuple[int, int], ...]]]  # (number of sequences, ((length, pieces of it), …))


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte strings and ids of a byte-level BPE tokenizer file, and the strings of its special tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they stand are supported")
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    return {bytes(shown[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}, special


def encoder(path: str):
    """Text to the ids that the tokenizer file gives without adding special tokens; their strings in a text have their own ids."""
    import public_tokenizers
    import tiktoken

    ranks, special = vocabulary(path)
    encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def pieces(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; ``ids`` is little-endian unsigned 32-bit."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + list(T._parse_datatype_string(
        "piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder(path)
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                ids = np.array([*encode(batch.column(1)[at].as_py() or ""), END_ID], dtype="<u4")
                key, head = batch.column(0)[at].as_py(), len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    body = ids[a:b].tobytes()
                    rows.append((key, i, a, b - a, zlib.crc32(body), *([body] if with_ids else [])))
                if len(rows) >= BATCH_PIECES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("_text")).mapInArrow(run, schema)


def reduce_dominated(counts: np.ndarray, capacity: int) -> Bins:
    """Fixes dominating sets of up to three pieces; ``counts`` (by length) keeps the remainder."""
    bins: Bins = []

    def fix(*lengths: int) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        t = min(int(counts[x]) // m for x, m in need.items())
        for x, m in need.items():
            counts[x] -= t * m
        bins.append((t, tuple(need.items())))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            free = counts[: room + 1].copy()
            if j <= room:
                free[j] -= 1
            fits = np.flatnonzero(free > 0)
            if not len(fits):
                fix(j)
                continue
            a, low = int(fits[-1]), [int(x) for x in np.repeat(fits[:3], np.minimum(free[fits[:3]], 3))[:3]]
            if a == room or len(low) < 2 or low[0] + low[1] > room:
                fix(j, a)
                continue
            if len(low) > 2 and sum(low) <= room:
                break  # three or more others fit: no small set is known to dominate
            best, smaller = _pairs(fits, free, room)
            second = free.copy()
            second[a] -= 1
            partners = np.flatnonzero(second[: room - a + 1] > 0)
            if a >= best:
                fix(j, a)
            elif len(partners) and smaller <= partners[-1]:
                fix(j, a, int(partners[-1]))
            else:
                break
    return bins


def _pairs(fits: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int]:
    """Over pairs that fit: the largest sum, and the largest smaller member."""
    best = smaller = 0
    for y in fits.tolist():
        x = fits[np.searchsorted(fits, room - y, side="right") - 1] if room - y >= fits[0] else 0
        if x < y or (x == y and free[y] < 2):
            at = np.searchsorted(fits, room - y, side="right") - 2
            if x != y or at < 0 or fits[at] < y:
                continue
            x = fits[at]
        best, smaller = max(best, int(x) + y), max(smaller, y)
    return best, smaller


def best_fit(counts: np.ndarray, capacity: int) -> Bins:
    """Best fit by decreasing length, over groups of equally filled sequences."""
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(room: int, t: int, held: tuple[tuple[int, int], ...]) -> None:
        if t:
            open_.setdefault(room, []).append((t, held))

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                each = capacity // s
                put(capacity - each * s, n // each, ((s, each),))
                put(capacity - n % each * s, 1 if n % each else 0, ((s, n % each),))
                break
            t, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
            each = room // s
            use = min(t, n // each)
            put(room - each * s, use, (*held, (s, each)))
            n -= use * each
            if use < t and n:
                put(room - n * s, 1, (*held, (s, n)))
                use, n = use + 1, 0
            put(room, t - use, held)
    return [g for group in open_.values() for g in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Bins:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def runs_of(bins: Bins) -> dict[str, np.ndarray]:
    """For each length, consecutive piece numbers and where they go: arrays sorted by ``(length, first)``."""
    given: dict[int, int] = {}
    rows, base = [], 0
    for t, held in bins:
        offset = 0
        for length, m in held:
            rows.append((length, given.get(length, 0), base, m, offset))
            given[length] = given.get(length, 0) + t * m
            offset += length * m
        base += t
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "each", "offset"), table_.T))


def pack(found: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of :func:`pieces`."""
    spark = found.sparkSession
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.sparkContext.broadcast(runs_of(plan(histogram, capacity)))
    order = ["doc_id", "piece", "ids_crc32"]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    numbered = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    numbered = numbered.join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).select(*found.columns, "_rank")
    schema = T.StructType(list(found.schema) + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        keys = (r["length"] << 48) | r["first"]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            k = rank - r["first"][at]
            seq = r["base"][at] + k // r["each"][at]
            offset = r["offset"][at] + k % r["each"][at] * length
            cols = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(seq), pa.array(offset)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(written(pieces(docs, path, text, id_col, capacity, with_ids), "pieces"), capacity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
