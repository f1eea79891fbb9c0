"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import op11_periodic_runs as op11

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(w, least=6):
    """All runs by definition: for each period, the maximal stretches that keep it."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 4 * p):
                found.setdefault((s, i + p - s), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(i, words):
    h = -1 if i is None else zlib.crc32(str(i).encode())
    n = len(words)
    if h < 0 or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def digests(i, text):
    w = planted(i, SPACED.findall(text or ""))
    runs = runs_of(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
    )


def texts(seed, n):
    rnd = random.Random(seed)
    for _ in range(n):
        kinds = rnd.choice([1, 2, 2, 3, 5, 50])
        w = ["".join(rnd.choice("abé") for _ in range(2)) if kinds > 3 else rnd.choice("xyz"[:kinds]) for _ in range(rnd.randrange(0, 70))]
        if w and rnd.random() < 0.6:
            unit = w[: rnd.randrange(1, 7)]
            w = w[: rnd.randrange(len(w))] + unit * rnd.randrange(3, 12) + w[rnd.randrange(len(w)) :]
        yield rnd.choice([" ", "\n", "\t "]).join(w)


@pytest.mark.parametrize("least", [6, 9])
def test_runs_of_many_texts_of_one_slice(least):
    rnd = random.Random(least)
    for _ in range(60):
        words = [[rnd.randrange(k) for _ in range(rnd.randrange(0, 50))] for k in (1, 2, 2, 3, 7)]
        codes = np.array([c for w in words for c in w], dtype=np.int64)
        doc = np.repeat(np.arange(5), [len(w) for w in words])
        got = [list(map(int, r)) for r in zip(*op11.find_runs(codes, doc, 5, least))]
        assert got == [[d, *r] for d, w in enumerate(words) for r in runs_of(w, least)]


def test_agreement_by_grammar_is_exact_in_both_directions():
    rnd = random.Random(3)
    for kinds in (1, 2, 4):
        w = [rnd.randrange(kinds) for _ in range(200)]
        grammar = op11.Grammar(np.array([-1, *w, -2]))
        grammar.compress(3)
        x = np.array([rnd.randrange(200) for _ in range(500)])
        y = np.minimum(x + 1 + np.array([rnd.randrange(40) for _ in range(500)]), 200)
        x, y = x[x < y], y[x < y]
        ahead, behind = grammar.agree(x + 1, y + 1), grammar.agree(x + 1, y + 1, back=True)
        for a, b, f, r in zip(x, y, ahead, behind):
            assert f == next((k for k in range(201) if b + k >= 200 or w[a + k] != w[b + k]), None)
            assert r == next((k for k in range(201) if a - k <= 0 or w[a - k - 1] != w[b - k - 1]), None)


def test_digests_of_documents(spark):
    rows = list(enumerate(texts(1, 300))) + [(300, None), (301, ""), (302, " \n"), (303, "a " * 6), (303, "a " * 6), (304, "a " * 5), (None, "b c " * 9)]
    rows += [(k, "one two three four five six seven " * 300 + "end") for k in range(400, 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("start", "length", "_text", "n_runs")})
    got = op11.run_digests(docs.repartition(3)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    ).collect()
    want = [digests(i, t) for i, t in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20 and sum(w[1] > 0 for w in want) > 60
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_very_long_text_and_many_periods(spark):
    unit = [f"w{k}" for k in range(5000)]
    long_ = "start " + " ".join(unit * 5) + " stop " + "z " * 3000
    row = op11.periodic_runs(spark.createDataFrame([(1, long_)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 25000, 5000), (25002, 3000, 1)]
    assert row.collapsed == "start " + " ".join(unit) + " stop z" and row.n_repeated == 20000 + 2999


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op11.run_digests(empty).count() == 0 and op11.periodic_runs(empty).count() == 0
