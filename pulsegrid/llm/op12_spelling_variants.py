"""Spelling variants over a variable-length gram index.

Words are runs of Latin letters (``[A-Za-z\\u00C0-\\u00FF]+``), A-Z lowered, of at
least ``min_chars`` code points that occur at least ``min_count`` times in all.
Two words are near if one inserted, deleted or replaced code point leads from
one to the other.  A word's form is its most frequent near word, if that is at
least ``ratio`` times as frequent; its root is the end of the chain of forms.

1. *Gram dictionary.*  Grams of 2 to ``Q_MAX`` code points, as a pruned trie: a
   gram in more than one of ``SHARE`` words is continued by a longer one, a rarer
   one is a leaf, and nothing below a leaf is kept.  What is continued numbers at
   most ``SHARE`` times the mean number of grams of a word, whatever the corpus,
   so that part of the dictionary goes to every task.
2. *Decomposition.*  The variable grams of a word are, for each place, the path
   down the trie up to a leaf, or up to the end of the word.
3. *Affected grams.*  An edit at a place affects the grams that hold it, and at
   the very end those that the end stopped: at most ``Q_MAX`` of them, so a word
   of ``n`` code points keeps ``n - 1 - Q_MAX`` grams at least.  Both words of a near pair keep
   the *same* grams, at the same distance from the start before the edit and from
   the end behind it.  For every edit of a word, the rarest ``MERGED`` grams that it
   leaves alone, with those distances, are one key; words have few distinct keys.
4. *List merging.*  The lists of those grams are merged by joining on the key: a
   replaced place against a replaced place, a deleted one against an inserted one.
   No near pair is lost, and only words that agree on all merged grams meet.
5. *Verification.*  Edit distance, with a bound of one, on the pairs that met.

Edge cases: null and empty texts have no words; a null id counts as an empty
string where ids matter (:func:`word_counts`); rows that repeat count again.
Ties between forms go to the smallest word in code-point order.  No words: an
empty result.  Other columns are not read.  Very long texts and words are
processed whole; memory follows the longest.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels
from .rows import table, written

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
Q_MIN, Q_MAX = 2, 4
#: A gram is continued when more than one word in so many holds it.
SHARE = 1_000
#: Gram lists merged into one key.
MERGED = 4
#: One run in so many loses a code point, where that is asked for.
EDITED = 31

_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, each continuing one of ``before``, a byte of all ranges at a time."""
    order = np.argsort(start - end, kind="stable")
    size = (end - start)[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    left = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for k, live in enumerate(left):
        byte = data[start[order[:live]] + k]
        state[:live] = _CRC[(state[:live] ^ byte) & 0xFF] ^ (state[:live] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counts(texts: pa.Array, ids: list, min_chars: int, edited: int) -> Iterator[pa.RecordBatch]:
    for i, j, data, offs in kernels.slices(texts):
        mask = _ASCII[data]
        lead = data == _LEAD
        mask |= lead
        mask[1:] |= lead[:-1]
        start, end, doc = kernels.spans(mask, offs)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        size = chars[end] - chars[start]
        long_ = np.flatnonzero(size >= min_chars)
        if not len(long_):
            continue
        start, end, size, doc = start[long_], end[long_], size[long_], doc[long_]
        low = kernels.LOWER[data]
        cut: Counter[str] = Counter()
        if edited:
            head = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[i:j]], dtype=np.uint32)
            h = _crc32(low, start, end, head[doc])
            hit = h % np.uint32(edited) == 0
            for a, b, at in zip(start[hit], end[hit], (h[hit] % size[hit]).tolist()):
                word = low[a:b].tobytes().decode()
                if len(word) > min_chars:
                    cut[word[:at] + word[at + 1 :]] += 1
            start, end = start[~hit], end[~hit]
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[start] += 1
        np.subtract.at(inside, end, 1)
        codes, words = kernels.coded(low, np.cumsum(inside[:-1]).astype(bool), start, end)
        n = np.bincount(codes, minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([words.cast(pa.large_string()), pa.array(list(cut), pa.large_string())]).cast(pa.string()),
             pa.array(np.concatenate([n, np.fromiter(cut.values(), np.int64, len(cut))]))], names=["word", "n"],
        )


def word_counts(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, edited: int = 0,
) -> DataFrame:
    """``(word, n)`` of all words.

    With ``edited``, a run whose crc32 of ``id:run`` it divides loses a code point first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counts(batch.column(1), batch.column(0).to_pylist() if edited else [], min_chars, edited)

    parts = docs.select(docs[id_col].cast("string"), docs[text].cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class _Grams:
    """Code points of a batch of words end to end, and hashes of the grams that start at each."""

    def __init__(self, words: pa.Array) -> None:
        self.size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = "".join(words.to_pylist())
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(self.size)), self.size)
        self.place = np.arange(len(points)) - self.first[self.word]
        self.left = self.size[self.word] - self.place
        self.hash: dict[int, np.ndarray] = {}
        with np.errstate(over="ignore"):
            h = kernels.mix64(points)
            for q in range(2, Q_MAX + 1):
                nxt = np.roll(points, 1 - q)
                h = kernels.mix64(h * kernels.MIX[1] + nxt)
                self.hash[q] = h


def dictionary(vocab: DataFrame, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams in more than ``threshold`` places of the words, sorted, and how many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g = _Grams(batch.column(0))
                held = np.concatenate([g.hash[q][g.left >= q] for q in range(Q_MIN, Q_MAX + 1)])
                gram, n = np.unique(held, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    rows = (
        vocab.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        .where(F.col("n") > threshold).toPandas()  # fewer than grams in all / threshold rows
    )
    gram = rows["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return gram[order], rows["n"].to_numpy().astype(np.int64)[order]


def _keys(words: pa.Array, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word number, key, role)``; roles: 0 a replaced, 1 a deleted, 2 an inserted code point."""
    g = _Grams(words)
    grams = np.flatnonzero(g.left >= Q_MIN)
    h, left = g.hash[Q_MIN][grams], g.left[grams]
    size = np.full(len(grams), Q_MIN)

    def seen(x: np.ndarray) -> np.ndarray:
        """How often a gram occurs, 0 where it is not frequent."""
        if not len(frequent):
            return np.zeros(len(x), dtype=np.int64)
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        return np.where(frequent[at] == x, often[at], 0)

    rate = seen(h)
    for q in range(Q_MIN + 1, Q_MAX + 1):
        go = np.flatnonzero((size == q - 1) & (rate > 0) & (left >= q))
        h[go] = g.hash[q][grams[go]]
        size[go] = q
        rate[go] = seen(h[go])
    stopped = (rate > 0) & (size < Q_MAX)  # by the end of the word
    # the rarest grams of each word; an edit affects Q_MAX at most, so no more are needed
    word, place = g.word[grams], g.place[grams]
    order = np.lexsort((place, h, rate, word))
    count = np.bincount(word, minlength=len(words))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    width = MERGED + Q_MAX
    order, rank = order[rank < width], rank[rank < width]
    shape = (len(words), width)
    begin, stop, gram, ended = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.uint64), np.zeros(shape, bool)
    real = np.zeros(shape, dtype=bool)
    to = (word[order], rank)
    begin[to], stop[to], gram[to], ended[to], real[to] = place[order], place[order] + size[order], h[order], stopped[order], True

    edits = g.size + 1
    w = np.repeat(np.arange(len(words)), edits)
    at = (np.arange(len(w)) - np.repeat(np.cumsum(edits) - edits, edits))[:, None]
    p, e, real, ended = begin[w], stop[w], real[w], ended[w]
    n = g.size[w][:, None]
    out = []
    with np.errstate(over="ignore"):
        from_start = kernels.mix64(gram[w] + kernels.mix64(p.astype(np.uint64)))
        from_end = kernels.mix64(gram[w] ^ kernels.mix64((n - p).astype(np.uint64) + np.uint64(1 << 32)))
        sided = np.where(e <= at, from_start, from_end)
        outside = real & ~((p <= at) & (at < e))
        between = real & ((p >= at) | ((e <= at) & ~(ended & (at == n))))
        for role, free, token, total in ((0, outside, from_start, n), (1, outside, sided, n), (2, between, sided, n + 1)):
            chosen = free & (np.cumsum(free, axis=1) <= MERGED)
            key = kernels.mix64((token * chosen).sum(axis=1, dtype=np.uint64) ^ kernels.mix64((2 * total[:, 0] + (role > 0)).astype(np.uint64)))
            some = np.flatnonzero((at < n)[:, 0]) if role < 2 else np.arange(len(w))
            both = np.lexsort((key[some], w[some]))
            ww, kk = w[some][both], key[some][both]
            new = np.ones(len(ww), dtype=bool)
            new[1:] = (ww[1:] != ww[:-1]) | (kk[1:] != kk[:-1])
            out.append((ww[new], kk[new], np.full(int(new.sum()), role, dtype=np.int8)))
    return tuple(np.concatenate(c) for c in zip(*out))


def near_words(vocab: DataFrame) -> DataFrame:
    """``(x, nx, y, ny)``: every pair of near words once, ``x < y``; ``vocab`` is a written ``(word, n)``, unique on ``word``."""
    spark = vocab.sparkSession
    held = spark.sparkContext.broadcast(dictionary(vocab, max(1, vocab.count() // SHARE)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                word, key, role = _keys(part.column(0), *held.value)
                at = pa.array(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(role), part.column(0).take(at), part.column(1).take(at)], names=["key", "role", "word", "n"]
                )

    keys = vocab.select("word", "n").mapInArrow(emit, "key long, role byte, word string, n long")
    a = keys.select("key", F.col("role").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = keys.select("key", F.col("role").alias("rb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "key").where("(ra = 0 and rb = 0 and a < b) or (ra = 1 and rb = 2)").where(F.levenshtein("a", "b", 1) == 1)
    swap = F.col("a") > F.col("b")
    return met.select(
        F.least("a", "b").alias("x"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("nx"),
        F.greatest("a", "b").alias("y"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("ny"),
    ).distinct()


def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every ``(word, form)``: the last of the chain of forms, by doubling the steps taken.

    Frequencies rise along a chain, so it ends; rounds are logarithmic in its length.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        roots = step.select("word", "root")
        if not step.where("on").take(1):
            return roots


def spelling_forms(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n)``."""
    vocab = written(vocab, "vocabulary")
    both = F.inline(F.array(
        F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("near_n")),
        F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("near_n")),
    ))
    best = near_words(vocab).select(both).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    )
    frequent = -F.col("best.m") >= ratio * F.col("n")
    marked = written(
        vocab.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("best.w")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"),
        ), "forms",
    )
    roots = follow(marked.where("form is not null"))
    return marked.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edited: int = 0) -> DataFrame:
    """Words of the documents with their forms and roots."""
    return spelling_forms(word_counts(docs, text, id_col, edited=edited))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), edited=EDITED)
