"""Operators on pairs, and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import op3_line_dedup as op3, op7_winnowing as op7, op8_packing as op8, op9_ngram_jaccard as op9, op10_repetition as op10
from pulsegrid.llm.graph import components

LOWERED = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [(901, None), (902, ""), (903, " \n "), (904, "two words"), (904, "two words"), (905, "TWO words"), (None, "a row without an id at all")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("node", "n", "label", "key", "line", "words", "gram", "x", "_id")})


def corpus(seed, n=160):
    """Prose with exact copies, near copies, shared passages and repeated lines."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage, line = prose(30), prose(12)
    rows = []
    for i in range(n):
        kind = rnd.randrange(6)
        if kind < 2 or not rows:
            text = prose(rnd.randrange(3, 90)) + "\n" + prose(8)
        elif kind == 2:
            text = rnd.choice(rows)[1]
        elif kind == 3:
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randrange(1, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            text = " ".join(words)
        elif kind == 4:
            text = f"{prose(20)}\n{line}\n{prose(20)} {passage} {prose(9)}"
        else:
            text = rnd.choice(rows)[1].upper() + rnd.choice(["", "!"])
        rows.append((i, text))
    return rows


def sets_of(text, k=5):
    words = SPACED.findall((text or "").translate(LOWERED))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def classes_of(rows):
    """Brute force: component name of every (id, text)."""
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: sets_of(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    name = {}
    for i, t in rows:
        if sets[t or ""] and i is not None:
            name[find(t or "")] = min(i, name.get(find(t or ""), i))
    return [(i, len(sets[t or ""]), (name.get(find(t or "")) if sets[t or ""] else i)) for i, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_op9_components(spark, seed):
    rows = corpus(seed) + EDGE
    got = op9.classes(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    want = classes_of(rows)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = collections.Counter(r.doc_id for r in op9.keep_one_per_class(frame(spark, rows)).collect())
    names = {c for _, n, c in want if n}
    assert kept == collections.Counter([*names, 901, 902, 903])


def test_op9_thresholds_are_exact(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, word(0, 11)), (2, word(1, 12)), (3, word(100, 112)), (4, word(100, 111) + " z"), (5, word(200, 207)), (6, word(200, 208))]
    got = {r.doc_id: r.component_id for r in op9.classes(frame(spark, rows)).collect()}
    assert got == {i: c for i, _, c in classes_of(rows)}
    assert got[2] == 1 and got[6] == 5


def test_op9_one_large_cluster_around_the_threshold(spark):
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for _ in range(rnd.randrange(1, 9)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = {i: c for i, _, c in classes_of(rows)}
    assert 20 < len(set(want.values())) < 100
    assert {r.doc_id: r.component_id for r in op9.classes(frame(spark, rows)).collect()} == want


def test_op9_sketches_bound_what_two_sets_do_not_share():
    rnd = random.Random(12)
    sets = [sorted(rnd.sample(range(1 << 40), rnd.randrange(0, 300))) for _ in range(40)]
    sets += [sorted(set(s[: len(s) // 2]) | set(rnd.sample(range(1 << 40), 9))) for s in sets]
    h = np.array([x for s in sets for x in s], dtype=np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words = op9.parity_sketches(h, doc, len(sets))
    assert words.shape == (len(sets), op9.SKETCH // 64)
    for i in range(len(sets)):
        for j in range(i):
            apart = sum(int(a ^ b).bit_count() for a, b in zip(words[i].view("<u8"), words[j].view("<u8")))
            assert apart <= len(set(sets[i]) ^ set(sets[j])) and (apart == 0) == (set(sets[i]) == set(sets[j]))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 450)], "x long, y long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 450: 400, 500: 400}


def line_heads(rows):
    first, parent = {}, {}
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if SPACED.search(line) and t is not None:
                first[line] = min(first.get(line, (i, n)), (i, n), key=key)
                parent[line] = line

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        p = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
        return a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])

    long_ = [x for x in first if len(x) >= op3.MIN_CHARS]
    for i, a in enumerate(long_):
        for b in long_[:i]:
            if abs(len(a) - len(b)) <= 1 and near(a, b):
                parent[find(a)] = find(b)
    head = {}
    for x, p in first.items():
        head[find(x)] = min(head.get(find(x), p), p, key=key)
    return {x: (first[x], head[find(x)]) for x in first}


def test_op3_classes_and_removal(spark):
    rnd = random.Random(7)
    rows = corpus(3, 60) + EDGE
    for i in range(60):
        a = "".join(rnd.choice("ab é") for _ in range(rnd.randrange(18, 30)))
        at = rnd.randrange(len(a))
        rows.append((200 + 2 * i, a + "\nx"))
        rows.append((201 + 2 * i, rnd.choice([a[:at] + a[at + 1 :], a[:at] + "c" + a[at:], a[:at] + "c" + a[at + 1 :], a[:at] + "cc" + a[at:]]) + "\n" + a[:10]))
    heads = line_heads(rows)
    got = op3.line_classes(op3.lines_of(frame(spark, rows)))
    assert sorted(str(((r.first.doc_id, r.first.line_no), (r.head.doc_id, r.head.line_no))) for r in got.collect()) == sorted(map(str, heads.values()))
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        long_ = [n for n, x in enumerate(lines) if t is not None and x in heads and len(x) >= op3.MIN_CHARS]
        drop = {n for n in long_ if heads[lines[n]][1] != (i, n)}
        if not drop:
            want.append((i, t))
        elif len(drop) < len(long_):
            want.append((i, "\n".join(x for n, x in enumerate(lines) if n not in drop)))
    kept = op3.remove_repeated_lines(frame(spark, rows))
    assert kept.columns[:2] == ["doc_id", "text"] and "node" in kept.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(want)


def test_line_dedup_stage_keeps_unique_short_lines(spark):
    shared, other = "one licence line of all documents", "another long line that only the first holds"
    rows = [
        (1, f"{shared}\n{other}\na verse"), (2, f"{shared}\nroses are red\nviolets are blue"), (3, f"{shared}\n{other}"),
        (4, f"{shared}\na verse"), (5, f"x\n{shared}s\n \ny"), (6, "a verse"), (7, f"{shared}\na verse\nof its own"), (7, f"{shared}\na verse\nof its own"),
        (None, f"{shared}\nno id"), (8, None), (9, ""), (10, f"{shared}\n \n"),
    ]
    got = corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter([
        rows[0], (2, "roses are red\nviolets are blue"), (5, "x\n \ny"), rows[5], (7, "a verse\nof its own"), (7, "a verse\nof its own"),
        (None, "no id"), (8, None), (9, ""),
    ])


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_op3_banded_distance(spark, tau):
    rnd = random.Random(8)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 25)))
        b = list(a)
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(len(b))
            b[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
        b = "".join(b)
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    pairs = spark.createDataFrame(rows, "a string, b string").where(F.length("a") - F.length("b") <= tau)
    both = pairs.select(op3.banded_distance(F.col("a"), F.col("b"), tau).alias("g"), F.levenshtein("a", "b").alias("w")).collect()
    assert all((r.g == r.w) if r.w <= tau else r.g > tau for r in both)


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        words = ALNUM.findall((t or "").translate(LOWERED))
        for a in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[a : a + 10])].add(i)
    sizes = {len(w) for w in windows}
    for i, t in rows:
        words = ALNUM.findall((t or "").translate(LOWERED))
        mark, met = set(), set()
        for n in sizes:
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in windows:
                    met |= windows[tuple(words[a : a + n])]
                    mark.update(range(a, a + n))
        yield i, len(words), len(mark), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(mark)


@pytest.mark.parametrize("short", [False, True])
def test_op7_report(spark, short):
    rows = corpus(4, 80) + EDGE + [(902, "other text under a used id a b c d e f g h i j k l"), (910, "Foo-bar " * 8)]
    items = [(i, " ".join(rows[i][1].split()[2:16])) for i in range(0, 40, 3)]
    items = [(i, t) for i, t in items if len(ALNUM.findall(t)) >= 10] + [(100, "A b c d e f g h i j k"), (101, None), (102, "!!")]
    items += [(103, "foo BAR"), (104, "two words"), (105, "two words")] if short else []
    got = op7.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("doc_key").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, contamination(rows, items)))
    clean = op7.remove_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == sum(not r[-1] for r in contamination(rows, items))


def test_op7_without_items_or_documents(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in op7.report(frame(spark, corpus(5, 5)), items).collect())
    assert op7.report(frame(spark, []), spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")).collect() == []


def test_empty_tables(spark):
    none = frame(spark, [])
    assert op9.classes(none).collect() == [] and op9.keep_one_per_class(none).collect() == []
    assert op3.line_classes(op3.lines_of(none)).collect() == [] and op3.remove_repeated_lines(none).collect() == []


def test_pipeline_follows_its_stages(spark, tmp_path):
    """Every stage against brute force on its own input."""
    rows = [(i, t) for i, t in corpus(6, 90)]
    items = [(0, " ".join(rows[0][1].split()[:14])), (1, "zz zz zz zz zz zz zz zz zz zz zz")]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, held = docs.columns, rows
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in held}
            break
        assert out.columns == columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in op10.repetition(docs).collect()}
            want = [(i, t) for i, t in held if verdict[i]]
        elif name == "line_dedup":
            heads, want = line_heads(held), []
            for i, t in held:
                lines = t.split("\n")
                long_ = [n for n, x in enumerate(lines) if x in heads and len(x) >= op3.MIN_CHARS]
                drop = {n for n in long_ if heads[lines[n]][1] != (i, n)}
                if not drop or len(drop) < len(long_):
                    want.append((i, "\n".join(x for n, x in enumerate(lines) if n not in drop)))
        elif name == "near_duplicates":
            keep = {c for _, n, c in classes_of(held) if n}
            want = [(i, t) for i, t in held if i in keep or not sets_of(t)]
        else:
            bad = {r[0] for r in contamination(held, items) if r[-1]}
            want = [(i, t) for i, t in held if i not in bad]
        assert sorted(got) == sorted(want), name
        held = got
        docs = out
    assert corpus_pipeline.run(spark, path).count() == out.count()
