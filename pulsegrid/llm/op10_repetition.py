"""Quality rules by suffix arrays: how much of a text repeats within itself.

Words are runs between ASCII white space.  A suffix array over the words of each
text gives, through its longest-common-prefix intervals, the longest repeat that
starts at each word; a repeat that does not merely continue the one a word
earlier is maximal.  The spans of maximal repeats of at least ``min_repeat``
words are united, and two limits apply: the covered share of the words, and the
longest single repeat.  Each has a least number of words, so that a boilerplate
line that a short text holds twice does not decide: the share counts once
``min_covered`` words are covered, the longest repeat once it has ``min_longest``
words.  Both shares lie below the base rule's, which ends at a fifth of the
words; a larger share would reject nothing that the base rule keeps.

Edge cases: null and empty texts have no words and fail the base rule (fewer
than ten words).  Copies of a row are judged alike.  An empty table gives an
empty result.  Other columns are not read (statistics) or passed on untouched
(filter), whatever their names.  Very long texts are processed whole; memory is
a few dozen bytes per word, plus four bytes per word and doubling level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels
from .rows import annotate, keep_where, table

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Parameters of the method's own verdict.
MIN_REPEAT = 8
MAX_COVERED = 0.12
MIN_COVERED = 40
MIN_LONGEST = 20
MAX_LONGEST_SHARE = 0.05

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, n_maximal_repeats long"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _duplicate_lines(data: np.ndarray, offs: np.ndarray, word_start: np.ndarray, n_docs: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    mask = data != 0x0A
    start, end, doc = kernels.spans(mask, offs)
    if not len(start):
        return np.zeros(n_docs, dtype=np.int64)
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    codes, _ = kernels.coded(data, mask, start, end)
    pairs = np.stack([doc[has_word], codes[has_word].astype(np.int64)], axis=1)
    distinct = np.unique(pairs, axis=0)
    return np.bincount(pairs[:, 0], minlength=n_docs) - np.bincount(distinct[:, 0], minlength=n_docs)


def measure(
    texts: pa.Array, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
    min_longest: int = MIN_LONGEST, max_longest_share: float = MAX_LONGEST_SHARE, min_covered: int = MIN_COVERED,
) -> dict[str, pa.Array]:
    """Base counts, repetition measures and the verdict of each text of a batch."""
    parts: dict[str, list[np.ndarray]] = {}
    for i, j, data, offs in kernels.slices(texts):
        n = j - i
        mask = kernels.WORD_SPACED[data]
        start, end, doc = kernels.spans(mask, offs)
        n_words = np.bincount(doc, minlength=n)
        codes = kernels.coded(data, mask, start, end)[0] if len(start) else np.zeros(0, np.int64)
        length = kernels.suffix_repeats(codes.astype(np.int64), doc)
        where = np.flatnonzero(length >= WINDOW)
        repeat = kernels.union_length(where, np.full(len(where), WINDOW), len(length))
        carried = np.zeros(len(length), dtype=bool)
        carried[1:] = (length[:-1] == length[1:] + 1) & (doc[1:] == doc[:-1])
        spans = np.flatnonzero(~carried & (length >= min_repeat))
        covered = kernels.union_length(spans, length[spans], len(length))
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, doc, length)
        out = {
            "n_words": n_words,
            "word_chars": _per_text(mask & ((data & 0xC0) != 0x80), offs),
            "n_symbols": _per_text(_SYMBOL[data], offs),
            "n_dup_lines": _duplicate_lines(data, offs, start, n),
            "n_repeat_words": np.bincount(doc[repeat], minlength=n),
            "covered_words": np.bincount(doc[covered], minlength=n),
            "longest_repeat": longest,
            "n_maximal_repeats": np.bincount(doc[spans], minlength=n),
        }
        out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
        repetitive = ((out["covered_words"] >= min_covered) & (out["covered_words"] > max_covered * n_words)) | (
            (longest >= min_longest) & (longest > max_longest_share * n_words)
        )
        out["kept"] = ~out["base_failed"] & ~repetitive
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    names = [f.strip().split()[0] for f in FIELDS.split(",")]
    return {k: pa.array(np.concatenate(parts[k]) if k in parts else np.zeros(0, np.int64)) for k in names}


def repetition(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """One row per document: base counts, suffix-array measures and ``kept``."""
    return annotate(docs, text, lambda t: measure(t, **limits), FIELDS, keep=(id_col,))


def keep_unrepetitive(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents, with all their columns, that pass the rules."""
    return keep_where(docs, text, lambda t: measure(t, **limits)["kept"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
