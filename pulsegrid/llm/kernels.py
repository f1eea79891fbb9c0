"""Array kernels over Arrow string batches, used inside tasks.

Texts arrive as Arrow string columns, whose bytes already lie end to end; words
and lines are found with byte masks over a slice of them, so no Python object is
made per word.  A slice holds whole texts: at most ``SLICE_BYTES`` and
``SLICE_TEXTS`` of them, or one longer text.  Memory follows the slice, i.e. the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
SLICE_TEXTS = 1 << 15

#: Fixed sets: ASCII white space, and ASCII that is no word character once A-Z is lowered.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD_SPACED = np.ones(256, dtype=bool)
WORD_SPACED[list(SPACE)] = False
WORD_ALNUM = np.zeros(256, dtype=bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x61:0x7B] = WORD_ALNUM[0x80:] = True

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of whole texts; a null text is empty."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.fill_null("")
        if not len(part):
            continue
        wide = pa.types.is_large_string(part.type)
        offs = np.frombuffer(part.buffers()[1], dtype=np.int64 if wide else np.int32)
        offs = offs[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            j = min(j, len(part), i + SLICE_TEXTS)
            yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the runs where ``mask`` holds, cut at text borders: ``(start, end, text number)``."""
    n = len(mask)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    prev = np.empty(n, dtype=bool)
    prev[0], prev[1:] = False, mask[:-1]
    inner = offs[1:-1]
    prev[inner[inner < n]] = False
    start = np.flatnonzero(mask & ~prev)
    nxt = np.empty(n, dtype=bool)
    nxt[-1], nxt[:-1] = False, mask[1:]
    nxt[inner[(inner > 0) & (inner <= n)] - 1] = False
    end = np.flatnonzero(mask & ~nxt) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def coded(data: np.ndarray, mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Small exact codes of the runs, and the distinct byte strings they stand for."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    body = np.ascontiguousarray(data[mask])
    arr = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    enc = arr.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False), enc.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))


HASH_BITS = 48


def shingle_hashes(
    words: np.ndarray, doc: np.ndarray, n_docs: int, k: int, late: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the ``k``-word shingles, distinct per text, in the order ``(text, late, hash)``.

    ``words`` holds one hash per word and ``doc`` its text.  A text of fewer than
    ``k`` words is one shingle; one without words has none.  ``late`` is a bitmap
    (power-of-two bits, indexed by the low bits of the hash) of shingles that go
    last.  Text, flag and hash share one 64-bit key, so one plain sort does it.
    """
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    keys = []
    top = np.uint64(64 - HASH_BITS)

    def key(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        h = h >> top
        flag = np.uint64(0)
        if late is not None:
            bit = h & np.uint64(8 * len(late) - 1)
            flag = ((late[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(np.uint64)
        return ((d.astype(np.uint64) * np.uint64(2) + flag) << np.uint64(HASH_BITS)) | h

    with np.errstate(over="ignore"):
        if len(words) >= k:
            m = len(words) - k + 1
            h = np.zeros(m, dtype=np.uint64)
            for i in range(k):
                h = (h ^ words[i : m + i]) * MIX[1 + i % 2]
                h ^= h >> np.uint64(29)
            same = doc[:m] == doc[k - 1 :]
            keys.append(key(mix64(h[same]), doc[:m][same]))
        for d in np.flatnonzero((count > 0) & (count < k)):
            h = np.full(1, count[d], dtype=np.uint64)
            for w in words[first[d] : first[d + 1]]:
                h = mix64(h ^ w)
            keys.append(key(h, np.full(1, d)))
    all_ = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    if len(all_):
        new = np.ones(len(all_), dtype=bool)
        new[1:] = all_[1:] != all_[:-1]
        all_ = all_[new]
    return all_ & np.uint64((1 << HASH_BITS) - 1), (all_ >> np.uint64(HASH_BITS + 1)).astype(np.int64)


def text_shingles(data: np.ndarray, offs: np.ndarray, k: int, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_hashes` over lower-cased words between ASCII white space."""
    mask = WORD_SPACED[data]
    start, end, doc = spans(mask, offs)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, dictionary = coded(LOWER[data], mask, start, end)
    return shingle_hashes(word_hashes(dictionary)[codes], doc, len(offs) - 1, k, late)


def suffix_repeats(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the longest run of words from there that occurs elsewhere in its text.

    A suffix array by prefix doubling: level ``k`` ranks the windows of ``2**k``
    words, and only windows that are not yet alone are sorted again.  Neighbours
    in suffix order share the longest common prefix of their interval, found by
    descending through the stored ranks.  Texts never mix: the first symbol
    carries the text number.  Memory: four bytes per word and level.
    """
    n = len(codes)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), n - 1)
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1  # words up to the end of the text
    key = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank, open_ = _ranks(key[order], order, np.arange(n), n)
    levels, h = [rank], 1
    sa_order = order
    while open_.any():
        at = np.flatnonzero(open_)
        nxt = at + h
        ok = left[at] > h
        second = np.where(ok, rank[np.minimum(nxt, n - 1)] + 1, 0).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 1) + second
        sub = np.argsort(key, kind="stable")
        # ranks are the first place of each group in suffix order, so a group is refined in place
        base = rank[at][sub]
        new_group = np.ones(len(sub), dtype=bool)
        ks = key[sub]
        new_group[1:] = ks[1:] != ks[:-1]
        group_start = np.ones(len(sub), dtype=bool)
        group_start[1:] = base[1:] != base[:-1]
        pos = np.arange(len(sub))
        from_start = pos - np.maximum.accumulate(np.where(group_start, pos, 0))
        place = base + from_start
        lead = np.maximum.accumulate(np.where(new_group, pos, 0))
        new_rank = place[lead]
        sa_order[place] = at[sub]
        rank = rank.copy()
        rank[at[sub]] = new_rank
        alone = np.ones(len(sub), dtype=bool)
        alone[:-1] &= new_group[1:]
        alone &= new_group
        open_ = open_.copy()
        open_[at[sub]] = ~alone
        levels.append(rank)
        h *= 2
    a, b = sa_order[:-1], sa_order[1:]
    lcp = np.zeros(n - 1, dtype=np.int64)
    room = np.minimum(left[a], left[b])
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        fits = lcp[live] + (1 << k) <= room[live]
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # equal ranks at a level mean equal windows only where the windows lie inside both texts
        lcp[live] += np.where(fits & (levels[k][x] == levels[k][y]), 1 << k, 0)
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return longest


def _ranks(keys: np.ndarray, order: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(n, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    pos = np.arange(n)
    lead = np.maximum.accumulate(np.where(new, pos, 0))
    rank = np.empty(n, dtype=np.int32)
    rank[order] = lead
    alone = new.copy()
    alone[:-1] &= new[1:]
    open_ = np.empty(n, dtype=bool)
    open_[order] = ~alone
    return rank, open_


def union_length(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Marks the positions covered by any ``[start, start + length)``."""
    diff = np.zeros(n + 1, dtype=np.int64)
    np.add.at(diff, start, 1)
    np.add.at(diff, start + length, -1)
    return np.cumsum(diff[:n]) > 0
