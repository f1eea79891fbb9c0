"""N-gram Jaccard join over a token-group matrix.

The set of a text is its distinct ``k``-word shingles; two texts link when
``100 * |intersection| >= percent * |union|``.  The result is exact:

1. *Order.*  Shingles are ordered by (common or not, hash).  Which are common
   comes from a counting sketch over all texts: one counter per ``NOISE``
   shingles, summed in slices by the cluster, thresholded to a bitmap of fixed
   maximal size.  Any order is valid; this one keeps common passages out of the
   prefixes.
2. *Prefix.*  Similar texts share a shingle among their first
   ``n - ceil(t n) + 1``.  Only these are shuffled, as ``(shingle, text, n)``, and
   only those met in two texts are kept.
3. *Groups.*  Texts are partitioned into groups: every text is compared with two
   leaders among those that share a shingle with it, the one that holds it earliest
   in its order, so that has the least shingles of its own and is mostly what others
   were copied from, and a random one; the components of what proves similar to
   such leaders are the groups.  Links inside a group need no more search.
4. *Token-group matrix.*  The union of the members' prefix shingles of a group,
   one row per ``(shingle, group)``, with the most shingles that any member has from
   there on.  If a shingle is the first that two texts share, their overlap is at most
   what either has from there on; only rows of two groups that allow the overlap
   which their sizes require are opened, and the same bound is then applied to
   their members.
5. *Verification.*  Every text has a parity sketch of ``SKETCH`` bits; the bits in
   which two differ are a lower bound of the shingles they do not share, which drops
   most pairs.  Full sets are built for the texts that are left in a pair,
   and compared exactly.  Components of all links follow.

Nodes are distinct texts (64-bit hash of the text), so copies of one text cost
one row.  Edge cases: null text, no words: empty set, linked with nothing, own
component.  Fewer than ``k`` words: the sequence is the only shingle.  Rows that
repeat a ``doc_id`` stay and share the text's component.  A null ``doc_id`` is
never a component's name unless nothing else is in it.  Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import kernels
from .bitmaps import PIECE, has_bits, slot_bitmap
from .graph import components
from .rows import table, written

K = 5
PERCENT = 75

#: Shingles per counter of the sketch, its smallest and largest number of counters.
NOISE = 64
MIN_COUNTERS, MAX_COUNTERS = 1 << 16, 1 << 24
#: A shingle is common when its counter exceeds the mean by this many deviations, and this much.
DEVIATIONS, SURPLUS = 8, 8
EMIT_ROWS = 1 << 17
#: Draws of random leaders: a text among many similar ones meets about as many of them.
DRAWS = 8
#: Bits of a place in a text's order, and of the number of a row that a text has once.
PLACE_BITS, SLOT_BITS = 32, 4
#: Bits of the parity sketch of a text, and texts sketched at once.
SKETCH, SKETCHED = 512, 512
SIGN = np.int64(-(1 << 63))
#: Bits per wanted node in the bitmap that spares the cluster a shuffle of texts, and its largest size.
BITS_PER_NODE, MAX_BITS = 16, 1 << 27


def _ceil_div(a: str, b: int) -> str:
    return f"cast(floor(({a} + {b - 1}) / {b}) as bigint)"


def node_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Bitmap of the hash slots whose shingles are common; at most ``MAX_COUNTERS / 8`` bytes."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    counters = min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << int(np.ceil(np.log2(max(2, chars / 6 / NOISE))))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.uint32)
        held: list[np.ndarray] = []

        def fold() -> None:
            if held:
                np.add.at(total, np.concatenate(held), 1)
                held.clear()

        for batch in batches:
            for _, _, data, offs in kernels.slices(batch.column(0)):
                h, _ = kernels.text_shingles(data, offs, k)
                held.append((h & np.uint64(counters - 1)).astype(np.int64))
                fold()
        fold()
        if total.any():
            for piece in range(0, counters, PIECE):
                part = total[piece : piece + PIECE]
                narrow = part.astype(np.uint8) if part.max() < 256 else part
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece // PIECE], pa.int32()), pa.array([zlib.compress(narrow.tobytes(), 1)], pa.binary())],
                    names=["piece", "body"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = zlib.decompress(body.as_py())
                part = np.frombuffer(raw, dtype=np.uint8 if len(raw) == PIECE else np.uint32).astype(np.uint64)
                sums[piece] = sums[piece] + part if piece in sums else part
        for piece, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([int(part.sum())], pa.int64()), pa.array([part.astype("<u8").tobytes()], pa.binary())],
                names=["piece", "total", "body"],
            )

    pieces = texts.select("text").mapInArrow(count, "piece int, body binary").repartition("piece")
    sums = written(pieces.mapInArrow(merge, "piece int, total long, body binary"), "sketch")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / counters
    limit = mean + DEVIATIONS * mean**0.5 + SURPLUS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(b.as_py(), "<u8") > limit, bitorder="little").tobytes() for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["piece", "bits"])

    bitmap = np.zeros(counters // 8, dtype=np.uint8)
    for row in sums.select("piece", "body").mapInArrow(cut, "piece int, bits binary").toLocalIterator():
        at = row["piece"] * PIECE // 8
        bitmap[at : at + PIECE // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bitmap


def parity_sketches(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """``(n_docs, SKETCH / 64)`` words: whether an odd number of a text's shingles falls on each bit."""
    out = np.zeros((n_docs, SKETCH // 8), dtype=np.uint8)
    for at in range(0, n_docs, SKETCHED):
        a, b = np.searchsorted(doc, (at, at + SKETCHED))
        rows = min(SKETCHED, n_docs - at)
        cell = (doc[a:b] - at) * SKETCH + (h[a:b] & np.uint64(SKETCH - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=rows * SKETCH).reshape(rows, SKETCH) & 1
        out[at : at + rows] = np.packbits(odd.astype(bool), axis=1, bitorder="little")
    return out.view("<i8")


def prefixes(texts: DataFrame, late, k: int, percent: int) -> DataFrame:
    """``(token, node, held)``: the prefix shingles of each distinct text of a task; ``held`` is its size and the shingle's place.

    Rows with a negative token carry what a text has once: its low bits say which,
    0 the size, the others a word of the sketch.  Three numbers per row, since this is the largest shuffle.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bitmap = late.value

        def rows(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "held"])

        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, offs in kernels.slices(batch.column(1)):
                h, d = kernels.text_shingles(data, offs, k, bitmap)
                n = np.bincount(d, minlength=j - i)
                own = nodes[i:j]
                fresh = np.zeros(j - i, dtype=bool)
                for at, node in enumerate(own.tolist()):
                    if node not in seen:
                        seen.add(node)
                        fresh[at] = True
                place = np.arange(len(h)) - (np.cumsum(n) - n)[d]
                size = n - -(-percent * n // 100) + 1
                take = fresh[d] & (place < size[d])
                token, who, place = h[take].astype(np.int64), d[take], place[take]
                for s in range(0, len(token), EMIT_ROWS):
                    w = who[s : s + EMIT_ROWS]
                    yield rows(token[s : s + EMIT_ROWS], own[w], (n[w] << PLACE_BITS) | place[s : s + EMIT_ROWS])
                w = np.flatnonzero(fresh)
                once = np.concatenate([n[w][:, None], parity_sketches(h, d, j - i)[w]], axis=1)
                slot = np.arange(once.shape[1])
                yield rows(((own[w] << SLOT_BITS)[:, None] | slot | SIGN).reshape(-1), np.repeat(own[w], len(slot)), once.reshape(-1))

    return texts.mapInArrow(emit, "token long, node long, held long")


def full_sets(texts: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``(node, body)``: sorted shingle hashes, as bytes, of each text that occurs in ``pairs``.

    A bitmap of the wanted nodes picks the texts where they are read, so no text
    is shuffled; its false positives meet no pair.
    """
    spark = texts.sparkSession
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    bits = min(MAX_BITS, max(PIECE, 1 << int(np.ceil(np.log2(max(1, wanted.count() * BITS_PER_NODE))))))
    bitmap = spark.sparkContext.broadcast(slot_bitmap(wanted.select(F.expr(f"node & {bits - 1}").alias("slot")), bits))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            hit = np.flatnonzero(has_bits(bitmap.value, nodes & np.int64(bits - 1)))
            hit = np.array([i for i in hit if not (nodes[i] in seen or seen.add(nodes[i]))], dtype=np.int64)
            if not len(hit):
                continue
            held = batch.take(pa.array(hit))
            for i, j, data, offs in kernels.slices(held.column(1)):
                h, d = kernels.text_shingles(data, offs, k)
                cut = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=j - i))])
                bodies = [np.sort(h[a:b]).astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([held.column(0).slice(i, j - i), pa.array(bodies, pa.binary())], names=["node", "body"])

    return texts.mapInArrow(build, "node long, body binary").groupBy("node").agg(F.first("body").alias("body"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` whose sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i in range(len(x)):
                if x[i] != last:
                    last, left = x[i], np.frombuffer(batch.column(2)[i].as_py(), "<u8")
                right = np.frombuffer(batch.column(3)[i].as_py(), "<u8")
                short, long_ = (left, right) if len(left) <= len(right) else (right, left)
                at = np.searchsorted(long_, short)
                both = int((long_[np.minimum(at, len(long_) - 1)] == short).sum()) if len(short) else 0
                ok.append(100 * both >= percent * (len(left) + len(right) - both) and both > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    a = sets.select(F.col("node").alias("x"), F.col("body").alias("xb"))
    b = sets.select(F.col("node").alias("y"), F.col("body").alias("yb"))
    return pairs.join(b, "y").join(a, "x").select("x", "y", "xb", "yb").mapInArrow(compare, "x long, y long")


def overlap(percent: int, a: str, b: str) -> str:
    """Fewest shared shingles of two similar texts with ``a`` and ``b`` shingles."""
    return _ceil_div(f"{percent} * ({a} + {b})", 100 + percent)


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` whose sketches do not rule a link out."""
    a = sketches.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    b = sketches.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    apart = F.aggregate(F.zip_with("sx", "sy", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return pairs.join(b, "y").join(a, "x").where(apart <= F.expr(f"nx + ny - 2 * {overlap(percent, 'nx', 'ny')}")).select("x", "y")


def links(texts: DataFrame, k: int = K, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(sizes, edges)``: shingle count of each node, and links that connect every component.

    ``texts`` has ``node`` (the key of the text) and ``text``.  Links between
    members of one group that are not needed to connect it are not listed.
    """
    spark = texts.sparkSession
    late = spark.sparkContext.broadcast(common_shingles(texts, k))
    # one shuffle brings the rows of a shingle together; those met in one text only are not kept.
    # It is stated, so that it moves the rows as they are and not what the window computes from them.
    one = Window.partitionBy("token")
    place = f"held % {1 << PLACE_BITS}"
    early = F.min(F.expr(f"struct({place} as i, xxhash64(node, token % {DRAWS}) as h, node, held)")).over(one)
    drawn = F.min(F.expr(f"struct(xxhash64(node, token % {DRAWS}) as h, node, held)")).over(one)
    shared = written(
        prefixes(texts, late, k, percent).repartition("token")
        .withColumns({"early": early, "drawn": drawn, "first": F.min("node").over(one), "last": F.max("node").over(one)})
        .where("token < 0 or first <> last")
        .select("token", "node", "held", *[F.when(F.col("token") >= 0, F.col(f"{c}.{f}")).alias(f"{c}_{f}") for c in ("early", "drawn") for f in ("node", "held")]),
        "shared",
    )
    slot = F.expr(f"cast(token & {(1 << SLOT_BITS) - 1} as int)")
    words = [F.max(F.when(F.col("slot") == c, F.col("held"))) for c in range(SKETCH // 64 + 1)]
    sketches = written(
        shared.where("token < 0").select("node", "held", slot.alias("slot")).groupBy("node").agg(words[0].cast("int").alias("n"), F.array(*words[1:]).alias("sketch")),
        "sketches",
    )
    held = lambda c, n, i: [F.shiftright(c, PLACE_BITS).cast("int").alias(n), F.expr(f"cast({c} % {1 << PLACE_BITS} as int)").alias(i)]
    s = shared.where("token >= 0").distinct().select(
        "token", "node", *held("held", "n", "i"), "early_node", *held("early_held", "early_n", "early_i"), "drawn_node", *held("drawn_held", "drawn_n", "drawn_i")
    )

    a, b = "least(n, m)", "greatest(n, m)"
    alike = f"100 * {a} >= {percent} * {b}"
    met = f"least(n - i, m - j) >= {overlap(percent, 'n', 'm')}"  # if the shingle is the first that both have
    leader = F.explode(F.array(*[
        F.struct(F.col(f"{c}_node").alias("node"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_i").alias("i")) for c in ("early", "drawn")
    ]))
    stars = (
        s.select("node", "n", "i", leader.alias("l"))
        .select("node", "n", "i", F.col("l.node").alias("o"), F.col("l.n").alias("m"), F.col("l.i").alias("j"))
        .where("node <> o").where(alike).where(met)
        .select(F.least("node", "o").alias("x"), F.greatest("node", "o").alias("y")).distinct()
    )
    stars = written(likely(stars, sketches, percent), "stars")
    first = written(verify(stars, full_sets(texts, stars, k), percent), "links")
    groups = components(first)

    # the token-group matrix: the sizes found in each group, and the most that a member has from the shingle on
    member = s.select("token", "node", "n", "i").join(groups, "node", "left").withColumn("g", F.coalesce("label", "node")).drop("label")
    crowded = member.groupBy("token").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("token")
    member = written(member.join(crowded, "token", "left_semi"), "members")
    matrix = member.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.expr("n - i")).alias("rest"))
    p = matrix.select("token", F.col("g").alias("g1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("rest").alias("rest1"))
    q = matrix.select("token", F.col("g").alias("g2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rest").alias("rest2"))
    opened = written(
        p.join(q, "token").where("g1 < g2")
        .where(f"100 * hi2 >= {percent} * lo1 and 100 * hi1 >= {percent} * lo2 and least(rest1, rest2) >= {overlap(percent, 'lo1', 'lo2')}")
        .select("token", "g1", "g2", "lo2", "hi2", "rest2"), "opened",
    )
    left = member.select("token", F.col("g").alias("g1"), F.col("node").alias("x0"), "n", "i")
    right = member.select("token", F.col("g").alias("g2"), F.col("node").alias("y0"), F.col("n").alias("m"), F.col("i").alias("j"))
    against = f"100 * hi2 >= {percent} * n and 100 * n >= {percent} * lo2 and least(n - i, rest2) >= {overlap(percent, 'n', 'lo2')}"
    pairs = (
        opened.join(left, ["token", "g1"]).where(against).select("token", "g2", "x0", "n", "i")
        .join(right, ["token", "g2"]).where(alike).where(met)
        .select(F.least("x0", "y0").alias("x"), F.greatest("x0", "y0").alias("y")).distinct()
        .join(stars, ["x", "y"], "left_anti")
    )
    pairs = written(likely(pairs, sketches, percent), "pairs")
    second = written(verify(pairs, full_sets(texts, pairs, k), percent), "links")
    return sketches.select("node", "n"), first.unionByName(second)


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, node, n_shingles, label, component_id)``, one row per document."""
    texts = docs.select(node_key(docs[text]).alias("node"), docs[text].cast("string").alias("text"))
    sizes, edges = links(texts, k, percent)
    rows = written(
        docs.select(docs[id_col].alias("doc_id"), node_key(docs[text]).alias("node"))
        .join(sizes, "node", "left").join(components(edges), "node", "left")
        .select("doc_id", "node", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "node").alias("label")), "classes",
    )
    named = rows.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n_shingles > 0").join(named, "label").select("doc_id", "node", "n_shingles", "label", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(linked.columns))


def keep_one_per_class(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Texts without words are all kept.  Of rows that repeat the kept document, one is kept.
    """
    found = written(classes(docs, text, id_col, k, percent), "classes")
    winner = found.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("w"))
    keys = winner.select(F.col("w.doc_id").alias("_id"), F.col("w.node").alias("_node"))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), docs[id_col].alias("_id"), node_key(docs[text]).alias("_node"), docs[text].alias("_text"))
    has_word = F.col("_text").rlike(r"[^ \t\n\x0B\f\r]")
    hit = marked.where(has_word)
    kept = (
        hit.join(keys, hit["_id"].eqNullSafe(keys["_id"]) & (hit["_node"] == keys["_node"]), "left_semi")
        .withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_node").orderBy(F.lit(0)))).where("_n = 1")
    )
    return kept.select("_row.*").unionByName(marked.where(~F.coalesce(has_word, F.lit(False))).select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
