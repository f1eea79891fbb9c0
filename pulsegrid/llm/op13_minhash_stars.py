"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidates.

The set of a text is its distinct ``k``-word shingles; two texts link when
``100 * |intersection| >= percent * |union|``.  Every link is confirmed on full sets.

1. *One permutation.*  One hash per shingle: its top bits name a bin, and the
   smallest hash of a bin is the bin's value.  An empty bin takes the value of
   another, drawn again and again by a hash of the bin and the attempt until a
   filled one is met (optimal densification).
2. *Bands.*  ``BANDS`` keys of ``ROWS`` bins each, and as many that join two
   neighbouring bands.  Two sets at the threshold share a single band with
   ``1 - (1 - s**ROWS)**BANDS``, all but 6e-11 at 0.85 over independent bins.
3. *Stars.*  A bucket of ``m`` sets gives ``m - 1`` candidates: each member with
   the bucket's leader, the member that meets most others over all its buckets, so
   mostly the text that the others were copied from.
4. *Confirmation and further rounds.*  Candidates are compared on full sets, and
   links joined to components.  Buckets that still hold more than one component
   lose their leader and get the next one, until a round joins nothing more.

Candidates never outnumber the bucket rows of a round.  What stays open is a
pair none of whose common leaders links to both and that no chain of other links
joins; README gives the measured share of such documents.

Equal sets are one node (64-bit hash of the set; shingles are 48-bit hashes), so
copies cost one row each.  Edge cases: null text, no words: empty set, linked
with nothing, own component.  Fewer than ``k`` words: the sequence is the only
shingle.  Rows that repeat a ``doc_id`` stay and share the component.  A null
``doc_id`` names no component unless nothing else is in it.  Empty tables give
empty results; other columns are not read.  Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels
from .bitmaps import PIECE, has_bits, slot_bitmap
from .graph import components
from .rows import table, written

K = 5
PERCENT = 85
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Bits per wanted text in the bitmap that spares a shuffle of texts, and its largest size.
BITS_PER_TEXT, MAX_BITS = 16, 1 << 27


def bin_values(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """``(n_docs, BINS)`` densified smallest hashes; ``h`` ascends inside each text.  Texts without a shingle are all zero."""
    values = np.zeros((n_docs, BINS), dtype=np.uint64)
    filled = np.zeros((n_docs, BINS), dtype=bool)
    cell = (h * np.uint64(BINS) >> np.uint64(kernels.HASH_BITS)).astype(np.int64) + doc * BINS
    new = np.ones(len(h), dtype=bool)
    new[1:] = cell[1:] != cell[:-1]
    values.reshape(-1)[cell[new]] = h[new]
    filled.reshape(-1)[cell[new]] = True
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        with np.errstate(over="ignore"):
            draw = kernels.mix64(np.arange(BINS, dtype=np.uint64) + np.uint64(BINS * (attempt + 1)))
        other = (draw % np.uint64(BINS)).astype(np.int64)[col]
        ok = filled[row, other]
        values[row[ok], col[ok]] = values[row[ok], other[ok]]
        row, col = row[~ok], col[~ok]
        attempt += 1
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """``2 * BANDS`` keys per text: of each band, and of each band and the next one."""
    with np.errstate(over="ignore"):
        single = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), BANDS)).copy()
        cells = values.reshape(-1, BANDS, ROWS)
        for r in range(ROWS):
            single = kernels.mix64(single ^ cells[:, :, r])
        double = kernels.mix64(single * kernels.MIX[1] + np.roll(single, -1, axis=1))
    return np.concatenate([single, double], axis=1)


def _set_key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash per set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix64(h), dtype=np.uint64)])
        last = np.cumsum(n)
        return kernels.mix64(total[last] - total[last - n] + n.astype(np.uint64)).view(np.int64)


def signed(docs: DataFrame, text: str, id_col: str, k: int) -> DataFrame:
    """``(doc_id, text_key, node, n, keys)``: the set, its size and its band keys, one row per document."""
    source = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_key"), docs[text].cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in kernels.slices(batch.column(2)):
                h, d = kernels.text_shingles(data, offs, k)
                n = np.bincount(d, minlength=j - i)
                keys = band_keys(bin_values(h, d, j - i))
                width = np.where(n > 0, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(keys[n > 0].reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(_set_key(h, n)), pa.array(n.astype(np.int32)), lists],
                    names=["doc_id", "text_key", "node", "n", "keys"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(sign, f"doc_id {kind}, text_key long, node long, n int, keys array<long>")


def full_sets(docs: DataFrame, text: str, wanted: DataFrame, k: int) -> DataFrame:
    """``(node, body)``: sorted shingle hashes, as bytes, of the texts whose ``text_key`` is wanted.

    A bitmap of bounded size picks them where they are read; its false positives meet no candidate.
    """
    spark = docs.sparkSession
    bits = min(MAX_BITS, max(PIECE, 1 << int(np.ceil(np.log2(max(1, wanted.count() * BITS_PER_TEXT))))))
    bitmap = spark.sparkContext.broadcast(slot_bitmap(wanted.select(F.expr(f"text_key & {bits - 1}").alias("slot")), bits))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            hit = np.flatnonzero(has_bits(bitmap.value, keys & np.int64(bits - 1)))
            hit = [i for i in hit.tolist() if not (keys[i] in seen or seen.add(keys[i]))]
            if not hit:
                continue
            for _, _, data, offs in kernels.slices(batch.column(1).take(pa.array(hit))):
                h, d = kernels.text_shingles(data, offs, k)
                n = np.bincount(d, minlength=len(offs) - 1)
                cut = np.concatenate([[0], np.cumsum(n)])
                bodies = [h[a:b].astype("<u8").tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(_set_key(h, n)), pa.array(bodies, pa.binary())], names=["node", "body"])

    keyed = docs.select(F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))), docs[text].cast("string"))
    return keyed.mapInArrow(build, "node long, body binary").groupBy("node").agg(F.first("body").alias("body"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(lx, ly)``, the labels of the pairs ``(x, y, lx, ly)`` that link on their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                short, long_ = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(long_, short), len(long_) - 1)
                both = int((long_[at] == short).sum())
                ok[i] = 100 * both >= percent * (len(a) + len(b) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["lx", "ly"])

    a = sets.select(F.col("node").alias("x"), F.col("body").alias("xb"))
    b = sets.select(F.col("node").alias("y"), F.col("body").alias("yb"))
    return pairs.join(b, "y").join(a, "x").select("lx", "ly", "xb", "yb").mapInArrow(compare, "lx long, ly long")


def stars(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket but its leader: ``(key, node, n, mass, label, leader, leader_label, fits)``.

    ``fits``: the sizes allow a link.  A bucket that many share is a join with one row per key, which Spark splits.
    """
    lead = members.groupBy("key").agg(F.max(F.struct("mass", "node", "n", "label")).alias("lead"))
    low, high = F.least(F.col("n"), F.col("lead.n")), F.greatest(F.col("n"), F.col("lead.n"))
    return members.join(lead, "key").where("node <> lead.node").select(
        "key", "node", "n", "mass", "label", F.col("lead.node").alias("leader"), F.col("lead.label").alias("leader_label"),
        (100 * low >= percent * high).alias("fits"),
    )


def links(docs: DataFrame, text: str, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``(node, label)`` of every node that shares a bucket; ``rows`` is the written :func:`signed` table."""
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("text_key").alias("text_key"))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n", "text_key")
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = written(keyed.join(size, "key"), "buckets")
    per_node = written(met.groupBy("node").agg(F.sum("c").alias("mass"), F.first("text_key").alias("text_key")), "masses")
    sets = written(full_sets(docs, text, per_node.select("text_key"), k), "sets")
    members = met.select("key", "node", "n").join(per_node.select("node", "mass"), "node").withColumn("label", F.col("node"))
    labels = per_node.select("node", F.col("node").alias("label"))

    while True:
        star = written(stars(members, percent), "stars")
        x_first = F.col("node") < F.col("leader")
        pairs = star.where("fits and label <> leader_label").select(
            F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y"),
            F.when(x_first, F.col("label")).otherwise(F.col("leader_label")).alias("lx"),
            F.when(x_first, F.col("leader_label")).otherwise(F.col("label")).alias("ly"),
        ).distinct()
        fresh = written(confirmed(pairs, sets, percent).distinct(), "links")
        if not fresh.take(1):
            return labels
        # components of components: the graph of a later round has only what that round joined
        moved = written(components(fresh, "lx", "ly").select(F.col("node").alias("label"), F.col("label").alias("to")), "moved")
        relabel = lambda df: df.join(moved, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        labels = written(relabel(labels), "labels")
        # the leaders are gone from the buckets; buckets of one component have nothing left to find
        left = relabel(star.select("key", "node", "n", "mass", "label"))
        open_ = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        members = left.join(open_, "key")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document; ``kept`` marks the one that names its component."""
    rows = written(signed(docs, text, id_col, k), "signed")
    labels = links(docs, text, rows, k, percent)
    found = rows.where("n > 0").select("doc_id", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = found.join(named, "label").select("doc_id", "n", "component_id")
    every = linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
