"""Personal data by rules, extended by bootstrapped contexts.

*Base.*  Four kinds of identifiers are found by fixed patterns.  They are also
the seeds of the bootstrap.

*Bootstrap.*  A lexical pattern is the pair of words before an identifier.  The
graph joins patterns with instances: tokens of at least ``MIN_LENGTH`` characters that
hold a digit.  Spark scores it iteratively:

    pattern  = instances after it, weighted by their confidence, over *all* its occurrences in the corpus
    instance = 1 - product over its patterns of (1 - pattern)

Seeds keep confidence 1.  Patterns need ``MIN_SEEDS`` different seed values, and
their occurrences are counted over all texts, so ordinary word pairs score near
zero; only patterns that some instance besides seeds follows are scored.  Instances above ``THRESHOLD`` that overlap no base span are reported as
``context`` spans.

The wanted patterns reach the counting pass as a bitmap of bounded size, whose
false positives are dropped by a join; the graph itself stays distributed.  Texts
that several rows hold are marked by a second bitmap and counted under their key,
so that both sides of a score count each distinct text once.

Edge cases: null and empty texts have no spans.  Repeated rows get equal
results and count as evidence once, in patterns and in their occurrences alike.  Empty tables give
empty results.  Texts of any length are scanned whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels
from .bitmaps import PIECE, has_bits, slot_bitmap
from .rows import annotate, table, written

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NO_DIGIT = re.compile(r"[^0-9]")

MIN_LENGTH = 6
MIN_SEEDS = 3
THRESHOLD = 0.8
ROUNDS = 3
MAX_BITS = 1 << 27
CONTEXT_CHARS = 200
#: Occurrences a task holds before it sums and emits them.
HELD_ROWS = 1 << 21

FIELDS = (
    "doc_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,stop:int,kind:int>>, "
    "candidates array<struct<start:int,stop:int,pattern:long,value:long,seed:boolean>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base kinds, sorted."""
    found = []
    done = 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, m.end(), 0))
                done = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _pattern(text: str, start: int) -> int | None:
    """Signed hash of the two words before ``start``; None at the head of a text."""
    words = text[max(0, start - CONTEXT_CHARS) : start].encode("utf-8", "replace").lower().split()
    if len(words) < 2 or (start and text[start - 1] not in " \t\n\x0b\x0c\r"):
        return None
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words[-2:]], dtype=np.uint64)
    return int(pair_hash(h[:1], h[1:])[0])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return kernels.mix64(kernels.mix64(a) ^ b).view(np.int64)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and tokens with a digit that touch no base span, with their pattern."""
    found = [(a, b, True) for a, b, _ in base]
    edge = 0
    for m in DIGITS.finditer(text):
        if m.start() < edge:
            continue
        a, b = m.start(), m.end()
        while a > edge and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        while b < len(text) and text[b] not in " \t\n\x0b\x0c\r":
            b += 1
        edge = b
        while b > a and not (text[b - 1].isalnum()):
            b -= 1
        if b - a >= MIN_LENGTH:
            found.append((a, b, False))
    out = []
    for a, b, seed in found:
        if not seed and any(x < b and a < y for x, y, _ in base):
            continue
        p = _pattern(text, a)
        if p is not None:
            value = xxhash.xxh3_64_intdigest(text[a:b].encode("utf-8", "replace"))
            out.append({"start": a, "stop": b, "pattern": p, "value": value - (1 << 64) if value >> 63 else value, "seed": seed})
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(texts: pa.Array) -> dict[str, pa.Array]:
    rows = []
    for text in texts.to_pylist():
        text = text or ""
        base = base_spans(text)
        n = [0, 0, 0, 0]
        for s in base:
            n[s[2]] += 1
        key = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
        rows.append((
            key - (1 << 64) if key >> 63 else key, *n, hashlib.sha256(listed(base).encode()).hexdigest(),
            [{"start": a, "stop": b, "kind": k} for a, b, k in base], candidates(text, base),
        ))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("pattern", pa.int64()), ("value", pa.int64()), ("seed", pa.bool_())]))
    types = [*[pa.int64()] * 5, pa.string(), span, cand]
    names = ["doc_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "candidates"]
    cols = list(zip(*rows)) if rows else [[]] * len(types)
    return {n: pa.array(c, t) for n, c, t in zip(names, cols, types)}


def _bitmap(keys: DataFrame, name: str):
    """Broadcast bitmap of the low bits of ``name``, and how many bits that are."""
    bits = min(MAX_BITS, max(PIECE, 1 << int(np.ceil(np.log2(max(1, keys.count() * 16))))))
    return keys.sparkSession.sparkContext.broadcast(slot_bitmap(keys.select(F.expr(f"{name} & {bits - 1}").alias("slot")), bits)), np.int64(bits - 1)


def occurrences(texts: DataFrame, wanted: DataFrame, copied: DataFrame) -> DataFrame:
    """``(pattern, total)``: occurrences of the wanted word pairs before any third word, over all distinct texts.

    ``copied`` holds the ``doc_key`` of the texts that several rows have.  A task
    counts such a text once and under its key, where the tasks' equal counts meet.
    """
    bitmap, low = _bitmap(wanted, "pattern")
    copies, copies_low = _bitmap(copied, "doc_key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        seen: set[int] = set()

        def made(key: pa.Array, pattern: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array(pattern), pa.array(n.astype(np.int64))], names=["doc_key", "pattern", "n"])

        def sums() -> Iterator[pa.RecordBatch]:
            if held:
                pattern, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield made(pa.nulls(len(pattern), pa.int64()), pattern, n)

        for batch in batches:
            for i, j, data, offs in kernels.slices(batch.column(0)):
                mask = kernels.WORD_SPACED[data]
                start, end, doc = kernels.spans(mask, offs)
                if len(start) < 3:
                    continue
                key = np.array([xxhash.xxh3_64_intdigest(data[offs[d] : offs[d + 1]].tobytes()) for d in range(j - i)], dtype=np.uint64).view(np.int64)
                marked = has_bits(copies.value, key & copies_low)
                again = np.zeros(j - i, dtype=bool)
                for d in np.flatnonzero(marked):
                    again[d] = int(key[d]) in seen
                    seen.add(int(key[d]))
                codes, words = kernels.coded(kernels.LOWER[data], mask, start, end)
                h = kernels.word_hashes(words)[codes]
                inside = (doc[:-2] == doc[2:]) & ~again[doc[:-2]]
                p, d = pair_hash(h[:-2], h[1:-1])[inside], doc[:-2][inside]
                hit = has_bits(bitmap.value, p & low)
                p, d = p[hit], d[hit]
                shared = marked[d]
                if not shared.all():
                    held.append(p[~shared])
                    rows += len(held[-1])
                if shared.any():
                    pairs, n = np.unique(np.stack([key[d[shared]], p[shared]]), axis=1, return_counts=True)
                    yield made(pa.array(pairs[0]), pairs[1], n)
                if rows >= HELD_ROWS:
                    yield from sums()
                    rows = 0
        yield from sums()

    each = F.when(F.col("doc_key").isNull(), F.sum("n")).otherwise(F.max("n"))
    counted = texts.mapInArrow(count, "doc_key long, pattern long, n long").groupBy("doc_key", "pattern").agg(each.alias("n"))
    return counted.groupBy("pattern").agg(F.sum("n").alias("total")).join(wanted, "pattern", "left_semi")


def bootstrap(edges: DataFrame, texts: DataFrame, copied: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``(value, confidence)`` of the instances that are no seeds."""
    graph = written(edges.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "graph")
    wanted = written(
        # a pattern that only seeds follow can discover nothing, so its score is never needed
        graph.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others"))
        .where((F.col("seeds") >= min_seeds) & (F.col("others") > 0)).select("pattern"), "patterns"
    )
    totals = written(occurrences(texts, wanted, copied), "totals")
    graph = written(graph.join(totals, "pattern"), "graph")
    belief = graph.where("seed").select("value", F.lit(1.0).alias("confidence")).distinct()
    for _ in range(rounds):
        patterns = (
            graph.join(belief, "value").groupBy("pattern")
            .agg(F.least(F.lit(1.0), F.sum(F.col("n") * F.col("confidence")) / F.max("total")).alias("score"))
        )
        reached = graph.join(patterns, "pattern").groupBy("value").agg(
            F.max("seed").alias("seed"), (1 - F.product(1 - F.col("score"))).alias("found")
        )
        belief = written(reached.select("value", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("confidence"), "seed"), "belief").drop("seed")
    return belief.join(graph.where("seed").select("value").distinct(), "value", "left_anti")


def personal_data(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS
) -> DataFrame:
    """One row per document: base counts and digest, ``base`` spans, ``spans`` of both kinds as text."""
    found = written(annotate(docs, text, scan, FIELDS, keep=(id_col,)), "spans")
    each = found.select("doc_key", F.explode("candidates").alias("c")).select("doc_key", "c.*").distinct()
    copied = found.groupBy("doc_key").count().where("count > 1").select("doc_key")
    known = bootstrap(each, docs.select(docs[text].cast("string").alias("text")), copied, rounds, min_seeds).where(F.col("confidence") >= threshold)
    more = (
        each.where("not seed").join(known, "value").groupBy("doc_key")
        .agg(F.collect_set(F.struct("start", "stop", F.lit(len(KINDS)).alias("kind"))).alias("more"))
    )
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    all_ = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,stop:int,kind:int>>)"))),
                        lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int"))
    shown = F.array_join(F.transform(all_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    return found.join(more, "doc_key", "left").select(
        id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", shown.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_context")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
