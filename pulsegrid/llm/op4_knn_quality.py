"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed terms: its words, and the shapes of its words
(case, digits, punctuation, repetition).  On a bounded sample of labelled rows
(``MAX_LABELLED``, a parameter) inverse document frequencies and a truncated
singular value decomposition give the latent-semantic space.  The labelled
vectors and labels are broadcast: at most ``MAX_LABELLED * RANK`` numbers.  Every
document is projected and compared with all of them, in blocks, by exact cosine
products; the ``NEIGHBOURS`` most similar vote with their similarity as weight.

Labels are learned only from rows whose ``crc32(doc_id)`` leaves another remainder
modulo 4 than 2.  Only the text enters a score.

Edge cases: null and empty texts have no terms; their vector is zero, and so are
all similarities, and they get the mean label of the sample.  Without any label every score is 0.5.
Repeated rows get equal scores; a document labelled twice counts with both labels.
Null labels are ignored.  Empty tables give empty results.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import kernels
from .rows import annotate, table

MAX_LABELLED = 4096
TERMS = 2048
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 4
BLOCK = 512
THRESHOLD = 0.7

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    """Runs of small letters, capitals and digits shortened to one sign each, punctuation kept."""
    return _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word)))


def term_counts(data: np.ndarray, offs: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """Dense counts, one row per text: words in the lower half, shapes and repetition in the upper half."""
    n, half = len(offs) - 1, terms // 2
    out = np.zeros(n * terms, dtype=np.float32)
    mask = kernels.WORD_SPACED[data]
    start, end, doc = kernels.spans(mask, offs)
    if len(start):
        codes, words = kernels.coded(data, mask, start, end)
        pool: dict[bytes, int] = {}
        lexical, formal = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for i, w in enumerate(words.to_pylist()):
            lexical[i] = xxhash.xxh3_64_intdigest(w) % half
            s = shape(w)
            if s not in pool:
                pool[s] = half + xxhash.xxh3_64_intdigest(s) % (half - 1)
            formal[i] = pool[s]
        for column in (lexical[codes], formal[codes]):
            out += np.bincount(doc * terms + column, minlength=n * terms).astype(np.float32)
        again = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]))
        out += np.bincount(doc[again] * terms + terms - 1, minlength=n * terms).astype(np.float32)
    return out.reshape(n, terms)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Shares of each half, damped and weighted, as unit rows."""
    x = counts.copy()
    half = x.shape[1] // 2
    for part in (x[:, :half], x[:, half:]):
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
        np.sqrt(part, out=part)
    x *= idf
    x[:, :half] *= 0.5
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Projection, labelled unit vectors and labels; picklable and bounded by the sample's parameters."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log1p(max(1, len(counts)) / (1.0 + (counts > 0).sum(axis=0))).astype(np.float32)
        x = weighted(counts, self.idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.basis = vectors[:, np.argsort(values)[::-1][:rank]].astype(np.float32)
        self.vectors = self.unit(x @ self.basis)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        k = min(neighbours, len(self.labels))
        v = self.unit(weighted(counts, self.idf) @ self.basis)
        cosine = v @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-6, vote / np.maximum(total, 1e-6), self.prior), 0, 1).astype(np.float64)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id",
        max_labelled: int = MAX_LABELLED, rank: int = RANK) -> Model:
    """A model from at most ``max_labelled`` labelled rows, those with the smallest hashes of their ids."""
    ids = (
        labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull() & ~is_held_out(labels["doc_id"]))
        .select("doc_id", F.col(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    )
    sample = docs.select(docs[id_col].alias("doc_id"), docs[text].cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = annotate(sample, "text", lambda t: {"c": pa.array([r.astype("<f4").tobytes() for r in _counts(t)], pa.binary())}, "c binary", keep=("doc_id", "label"))
    # copies of an id could exceed the bound, so it is applied to the rows as well
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "c").limit(max_labelled).collect()
    counts = np.stack([np.frombuffer(r["c"], "<f4") for r in got]) if got else np.zeros((0, TERMS), np.float32)
    return Model(counts, np.array([r["label"] for r in got]), rank)


def _counts(texts: pa.Array):
    for i, j, data, offs in kernels.slices(texts):
        for a in range(0, j - i, BLOCK):
            b = min(a + BLOCK, j - i)
            yield from term_counts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def scores(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        out = [np.zeros(0)]
        for i, j, data, offs in kernels.slices(texts):
            for a in range(0, j - i, BLOCK):
                b = min(a + BLOCK, j - i)
                out.append(sent.value.score(term_counts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])))
        s = np.concatenate(out)
        return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return annotate(docs, text, run, "score double, predicted int", keep=(id_col,))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
