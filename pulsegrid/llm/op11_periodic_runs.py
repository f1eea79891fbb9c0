"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period ``q`` and at least
``max(min_length, 4 q)`` words that no neighbouring word extends.  Words are runs
between ASCII white space, compared byte by byte.

1. *Grammar.*  All texts of a slice lie end to end, each followed by a symbol of
   its own.  Rounds alternate block compression (equal neighbours become one
   symbol per letter and run length) and pair compression (symbols are split by a
   hash into left and right; a left one followed by a right one becomes one
   symbol).  Equal symbols of a level stand for equal words, and a level's
   boundaries depend on their neighbourhood alone.  Rounds end when every text is
   one symbol, after a logarithmic number of them; each level keeps its symbols
   and the maps between its places and the next level's.
2. *Exact extension.*  How far two places agree, to either side, is found by
   climbing: one step brings both places to boundaries of the next level, or finds
   them to differ; from there the query descends, one step per level.  All
   queries of a level are answered at once.
3. *Harmonic grid.*  A run of period ``p`` and at least ``4 p`` words holds a
   multiple of ``3 p`` among its first words but ``p``, so ``n / 3p`` places per
   period are enough, ``n log n`` in all.  Places whose own words differ from those
   ``p`` further are skipped; the others are extended to both sides.  Among
   equal stretches the smallest period stays, which is the stretch's smallest.

Edge cases: a null or empty text has no words and no run; its digests are those of
the empty string.  Rows that repeat are judged alike, a null ``doc_id`` too.  An
empty table gives an empty result; other columns are not read.  Texts are
processed whole in their task: a few dozen bytes per word, for the longest text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .rows import annotate, table

MIN_LENGTH = 6
#: Periods a run holds at least; the grid's step in periods is one less.
EXPONENT = 4
#: Grid places generated at once.
GRID_PLACES = 1 << 21


class Grammar:
    """Levels of a recompression of ``codes``, in which every text ends with a symbol of its own."""

    def __init__(self, codes: np.ndarray) -> None:
        self.symbols = [codes.astype(np.int64)]
        self.blocks: list[bool] = []
        self.up: list[np.ndarray] = []  # place -> node of the next level that holds it
        self.down: list[np.ndarray] = []  # node of the next level -> its first place

    def compress(self, final: int) -> None:
        """Rounds until ``final`` symbols are left."""
        turn = 0
        while len(self.symbols[-1]) > final:
            s = self.symbols[-1]
            same = s[1:] == s[:-1]
            if same.any():
                self._level(np.append(True, ~same), True)
                s = self.symbols[-1]
                if len(s) <= final:
                    break
            turn += 1
            self._pairs(s, turn)

    def _pairs(self, s: np.ndarray, turn: int) -> None:
        # ends of texts are negative and stay alone
        with np.errstate(over="ignore"):
            side = (kernels.mix64(s.astype(np.uint64) + (np.uint64(turn) << np.uint64(40))) & np.uint64(1)).astype(bool)
        inner = (s[:-1] >= 0) & (s[1:] >= 0)
        split = inner & (side[:-1] != side[1:])
        left_first = split & side[:-1]
        # of the two orientations, the one with more pairs
        paired = left_first if 2 * left_first.sum() >= split.sum() else split & ~side[:-1]
        if paired.any():
            self._level(np.append(True, ~paired), False)

    def _level(self, start: np.ndarray, block: bool) -> None:
        s = self.symbols[-1]
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(s)))
        head = s[first]
        wide = size > 1
        tail = size[wide] if block else s[first[wide] + 1]
        made = head.copy()
        if wide.any():
            fresh = int(s.max()) + 1
            key = head[wide] * (int(tail.max()) + 1) + tail
            made[wide] = fresh + np.unique(key, return_inverse=True)[1]
        self.symbols.append(made)
        self.blocks.append(block)
        self.up.append(np.append(np.cumsum(start) - 1, len(first)).astype(np.int32))
        self.down.append(np.append(first, len(s)).astype(np.int32))

    def _step(self, k: int, x: np.ndarray, y: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(places agreed on, whether the next level goes on)`` from boundaries ``x`` and ``y`` of level ``k``."""
        s, up, down = self.symbols[k], self.up[k], self.down[k]
        at, bt = (x - 1, y - 1) if back else (x, y)
        same = s[at] == s[bt]
        if not self.blocks[k]:
            return same.astype(np.int64), same
        a, b = (x - down[up[at]], y - down[up[bt]]) if back else (down[up[at] + 1] - x, down[up[bt] + 1] - y)
        return np.where(same, np.minimum(a, b), 0).astype(np.int64), same & (a == b)

    def agree(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from ``x`` and ``y`` on, or before them; an end of a text agrees with nothing."""
        sign = -1 if back else 1
        px, py = x.astype(np.int64).copy(), y.astype(np.int64).copy()
        peak = np.full(len(x), len(self.up), dtype=np.int64)
        live = np.arange(len(x))
        for k in range(len(self.up)):
            if not len(live):
                break
            up, down = self.up[k], self.down[k]
            a, b = px[live], py[live]
            rough = np.flatnonzero((down[up[a]] != a) | (down[up[b]] != b))
            if len(rough):
                step, on = self._step(k, a[rough], b[rough], back)
                a[rough] += sign * step
                b[rough] += sign * step
                stopped = live[rough[~on]]
                px[stopped], py[stopped], peak[stopped] = a[rough[~on]], b[rough[~on]], k
                go = np.ones(len(live), dtype=bool)
                go[rough[~on]] = False
                live, a, b = live[go], a[go], b[go]
            px[live], py[live] = up[a], up[b]
        # at the top every text is one symbol and its end: two different places of one text differ there
        order = np.argsort(-peak, kind="stable")
        reach = np.searchsorted(-peak[order], -np.arange(len(self.up)), side="left")  # queries whose peak lies above a level
        for k in range(len(self.up) - 1, -1, -1):
            q = order[: reach[k]]
            if not len(q):
                continue
            a, b = self.down[k][px[q]].astype(np.int64), self.down[k][py[q]].astype(np.int64)
            step, _ = self._step(k, a, b, back)
            px[q], py[q] = a + sign * step, b + sign * step
        return (px - x) * sign


def _grid(first: np.ndarray, count: np.ndarray):
    """``(place, period)`` of the harmonic grid over texts of ``count`` words from ``first``, in bounded pieces."""
    top = count // EXPONENT
    text = np.repeat(np.arange(len(count)), top)
    period = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    size = -(-(count[text] - period) // ((EXPONENT - 1) * period))
    done = np.cumsum(size)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + GRID_PLACES, side="right")))
        n = size[i:j]
        p = np.repeat(period[i:j], n)
        step = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(first[text[i:j]], n) + step * (EXPONENT - 1) * p, p
        i = j


def find_runs(codes: np.ndarray, doc: np.ndarray, n_docs: int, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """``(text, start, length, period)`` of all runs, by text, start and period; places count from the text's first word."""
    count = np.bincount(doc, minlength=n_docs)
    none = np.zeros(0, np.int64)
    if not len(codes) or count.max() < min_length:
        return none, none, none, none
    # one end symbol before everything and one behind every text, all different and negative
    first = np.cumsum(count) - count + np.arange(n_docs) + 1
    body = np.empty(len(codes) + n_docs + 1, dtype=np.int64)
    body[np.arange(len(codes)) + doc + 1] = codes
    body[np.append(0, first + count)] = -1 - np.arange(n_docs + 1)
    grammar = Grammar(body)
    grammar.compress(1 + n_docs + int((count > 0).sum()))
    found = []
    for place, p in _grid(first, count):
        hit = body[place] == body[place + p]
        place, p = place[hit], p[hit]
        ahead = grammar.agree(place, place + p)
        behind = grammar.agree(place, place + p, back=True)
        length = ahead + behind + p
        ok = length >= np.maximum(min_length, EXPONENT * p)
        found.append(np.stack([place[ok] - behind[ok], length[ok], p[ok]]))
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    text = np.searchsorted(first, start, side="right") - 1
    start = start - first[text]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def repeated_words(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Marks, over the words of all texts, those behind the first period of a run."""
    first = np.cumsum(count) - count
    return kernels.union_length(first[text] + start + period, length - period, int(count.sum()))


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> list[bytes]:
    """The words of each text joined by single spaces."""
    size = end - start + 1
    to = np.cumsum(size)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, dtype=np.uint8)
    at = np.repeat(to - size, size - 1) + np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1)
    src = np.repeat(start, size - 1) + np.arange(len(at)) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1)
    out[at] = data[src]
    total = np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64)
    cut = np.cumsum(total)
    raw = out.tobytes()
    return [raw[c - t : c - 1] if t else b"" for c, t in zip(cut, total)]


FIELDS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "n_repeated long"
)


def measure(texts: pa.Array, planted: np.ndarray | None = None, min_length: int = MIN_LENGTH, spans: bool = False) -> dict[str, pa.Array]:
    """Runs of each text of a batch.  ``planted``: per text an unsigned number or -1, see :func:`planted_words`."""
    parts: dict[str, list] = {}
    for i, j, data, offs in kernels.slices(texts):
        n = j - i
        mask = kernels.WORD_SPACED[data]
        start, end, doc = kernels.spans(mask, offs)
        count = np.bincount(doc, minlength=n)
        codes = kernels.coded(data, mask, start, end)[0] if len(start) else np.zeros(0, np.int64)
        if planted is not None:
            word = planted_words(planted[i:j], count)
            codes, start, end = codes[word], start[word], end[word]
        text, at, length, period = find_runs(codes, doc, n, min_length)
        gone = repeated_words(text, at, length, period, count)
        left = _joined(data, start[~gone], end[~gone], doc[~gone], n)
        cut = np.searchsorted(text, np.arange(n + 1))
        best = np.lexsort((period, at, -length, text))
        has = cut[1:] > cut[:-1]
        lead = best[np.minimum(cut[:-1], max(len(best) - 1, 0))] if len(best) else np.zeros(n, np.int64)
        rows = np.stack([at, length, period], axis=1).tolist()
        out = {"n_words": count, "n_runs": cut[1:] - cut[:-1], "n_repeated": np.bincount(doc[gone], minlength=n)}
        chosen = {"start": at, "length": length, "period": period, "exponent_milli": 1000 * length // np.maximum(period, 1)}
        for name, v in chosen.items():
            out[name] = pa.array(v[lead] if len(v) else np.zeros(n, np.int64), mask=~has)
        listed = ["".join("%d,%d,%d\n" % tuple(r) for r in rows[a:b]).encode() for a, b in zip(cut[:-1], cut[1:])]
        out["runs_sha256"] = [hashlib.sha256(b).hexdigest() for b in listed]
        out["collapsed_sha256"] = [hashlib.sha256(b).hexdigest() for b in left]
        if spans:
            out["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in rows[a:b]] for a, b in zip(cut[:-1], cut[1:])]
            out["collapsed"] = [b.decode("utf-8", "replace") for b in left]
        for k, v in out.items():
            parts.setdefault(k, []).append(v if isinstance(v, pa.Array) else pa.array(v))
    return {k: pa.concat_arrays(v) for k, v in parts.items()}


def planted_words(numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which word stands at each place once some texts are made periodic from a word on.

    Of a text with ``n`` words and number ``h``, ``h % 10 == 0``, each word ``i >= a``
    becomes word ``a + (i - a) % p`` with ``g = h // 10``, ``a = g % n`` and
    ``p = 1 + (n - a) // (3 + g % 8)``.  A negative number leaves its text alone.
    """
    first = np.cumsum(count) - count
    word = np.arange(int(count.sum()))
    for d in np.flatnonzero((numbers >= 0) & (numbers % 10 == 0) & (count > 0)):
        n, g = int(count[d]), int(numbers[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        word[first[d] + a : first[d] + n] = first[d] + a + np.arange(n - a) % p
    return word


def crc32_of(ids: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each id in decimal; -1 for null."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()], dtype=np.int64)


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """``(id, runs, collapsed, n_words, n_runs)``: all runs as a list of spans, and the text without the repeats' words."""
    fields = "n_words long, n_runs long, n_repeated long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return annotate(docs, text, lambda t: measure(t, None, min_length, spans=True), fields, keep=(id_col,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of which are made periodic first (:func:`planted_words`)."""
    return run_digests(table(spark, sf_dir, "documents"))


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: the greatest run and digests of all runs and of the collapsed text."""

    def both(texts: pa.Array, ids: pa.Array) -> dict[str, pa.Array]:
        return measure(texts, crc32_of(ids))

    return annotate(docs, "text", both, FIELDS, keep=("doc_id",), with_keys=True)
