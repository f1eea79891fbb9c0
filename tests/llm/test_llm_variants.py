"""Spelling variants and one-permutation near duplicates against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import op12_spelling_variants as op12, op13_minhash_stars as op13

LOWERED = {i: i + 32 for i in range(65, 91)}
LATIN = re.compile(r"[A-Za-zÀ-ÿ]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(901, None), (902, ""), (903, " \n "), (904, "two words"), (904, "two words"), (905, "TWO words"), (None, "a row without an id at all")]
CLASHING = ("node", "n", "label", "key", "word", "text_key", "keys", "mass", "leader", "c")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})


# --- spelling variants -----------------------------------------------------------------

def vocabulary(rows, edited=31):
    n = collections.Counter()
    for i, t in rows:
        for run in LATIN.findall(t or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if edited and h % edited == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms_of(n):
    out, form = {}, {}
    by_size = collections.defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    for w in n:
        around = [x for d in (-1, 0, 1) for x in by_size[len(w) + d] if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (n[w], len(around))
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, *out[w], n[form[w]] if form[w] else None))
    return rows


def wordy(seed, n=120):
    """Words of few syllables, with misspellings, in very different frequencies."""
    rnd = random.Random(seed)
    part = ["tion", "ent", "er", "on", "Á", "é", "ñan", "que", "re", "÷", "ing"]
    base = ["".join(rnd.choice(part) for _ in range(rnd.randrange(2, 7))) for _ in range(60)]
    heavy = [b for b in base if len(b) > 6][:6]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(0, 150)):
            w = rnd.choice(heavy if rnd.random() < 0.7 else base)
            if rnd.random() < 0.2 and len(w) > 2:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("aeé") + w[k:], w[:k] + rnd.choice("aoñ") + w[k + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op12_forms(spark, seed):
    rows = wordy(seed) + EDGE + [(950, "Abcdefgh" * 400 + " " + "Abcdefgh" * 400 + "x " + "abcdefgh" * 400), (951, "abcdefgh" * 400 + "x")] + [(952, "aaaaaaa aaaaaaaa " * 12)]
    got = op12.spelling_variants(frame(spark, rows).repartition(3), edited=31).collect()
    want = forms_of(vocabulary(rows))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[1] is not None for w in want) > 10


def test_op12_chains_and_ties(spark):
    n = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "abcdefx": 1, "tiesabc": 50, "tiesabd": 50, "tiesabe": 5, "lonely-no": 3, "échéancé": 2, "échéance": 20}
    got = op12.spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, forms_of(n)))
    root = {r.word: (r.form, r.root) for r in got}
    assert root["abcdefg"] == ("abcdefgh", "abcdefghij") and root["tiesabe"] == ("tiesabc", "tiesabc")


def test_op12_keys_join_every_near_pair():
    """Each edit of a word and its reverse meet in a key, for any dictionary."""
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 11))) for _ in range(120)})
    for share in (1, 5, 10**9):
        grams = op12._Grams(pa.array(words))
        held = np.concatenate([grams.hash[q][grams.left >= q] for q in (2, 3, 4)])
        gram, often = np.unique(held, return_counts=True)
        word, key, role = op12._keys(pa.array(words), gram[often > share], often[often > share])
        keys = collections.defaultdict(set)
        for w, k, r in zip(word.tolist(), key.tolist(), role.tolist()):
            keys[w, r].add(k)
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                if near(a, b) and (len(a), a) < (len(b), b):
                    assert keys[i, 0] & keys[j, 0] if len(a) == len(b) else keys[i, 2] & keys[j, 1], (a, b)


def test_op12_crc_of_many_ranges():
    rnd = random.Random(4)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, 40))) for _ in range(200)]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    head = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], dtype=np.uint32)
    got = op12._crc32(data, end - [len(w) for w in words], end, head)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


def test_op12_empty(spark):
    assert op12.spelling_variants(frame(spark, []), edited=31).count() == 0
    assert op12.spelling_variants(frame(spark, EDGE), edited=31).count() == 0


# --- near duplicates -------------------------------------------------------------------

def sets_of(text, k=5):
    words = SPACED.findall((text or "").translate(LOWERED))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def classes_of(rows, percent=85):
    sets = sorted({sets_of(t) for _, t in rows}, key=lambda s: sorted(s))
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(a)] = find(b)
    name = {}
    for i, t in rows:
        s = sets_of(t)
        if s and i is not None:
            name[find(s)] = min(i, name.get(find(s), i))
    out = []
    for i, t in rows:
        s = sets_of(t)
        c = name.get(find(s)) if s else i
        out.append((i, len(s), c, i == c))
    return out


def corpus(seed, n=200):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        kind = rnd.randrange(4)
        if kind == 0 or not rows:
            text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 150)))
        elif kind == 1:
            text = rnd.choice(rows)[1]
        else:
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            text = " ".join(words)
        rows.append((i, text.upper() if rnd.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_op13_components(spark, seed):
    rows = corpus(seed) + EDGE
    got = op13.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, classes_of(rows)))


def test_op13_one_large_cluster_around_the_threshold(spark):
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = list(base)
        for _ in range(rnd.randrange(1, 7)):
            words[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in op13.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c, _ in classes_of(rows)}


def test_op13_threshold_is_exact_and_long_texts_are_whole(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, word(0, 24)), (2, word(1, 25) + " q"), (3, word(100, 123)), (4, word(101, 124)), (5, word(1000, 31000)), (6, word(1000, 29000) + " end"), (7, word(200, 204)), (8, word(200, 204))]
    got = {r.doc_id: r.component_id for r in op13.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c, _ in classes_of(rows)} and got[6] == 5 and got[8] == 7


def test_op13_densified_bins():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 9).astype(np.uint64))
    values = op13.bin_values(h, np.array([1] * 9), 3)
    assert not values[0].any() and not values[2].any()
    own = {int(v) * op13.BINS >> 48: int(v) for v in h[::-1]}
    assert all(int(values[1, b]) == v for b, v in own.items()) and set(values[1].tolist()) <= set(h.tolist())
    assert len(set(values[1].tolist())) == len(own)


def test_op13_empty(spark):
    assert op13.near_duplicates(frame(spark, [])).count() == 0
    got = op13.near_duplicates(frame(spark, [(1, None), (None, "")])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["(1, 0, 1, True)", "(None, 0, None, True)"])
