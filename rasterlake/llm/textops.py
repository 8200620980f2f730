"""Vectorised word, shingle and line views over Arrow text buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. All separators are ASCII, so splitting UTF-8 bytes equals
splitting code points. Words and lines are identified by 64-bit polynomial hashes with a final avalanche.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 64, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_POW: dict[str, np.ndarray] = {"r": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["r"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("r", _R), ("i", _RINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["r"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_column(col) -> pa.LargeStringArray:
    """The column as one large_string array; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def raw(arr: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets (from 0)."""
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(arr: pa.LargeStringArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each."""
    if not len(arr):
        return
    ends = raw(arr)[1][1:]
    lo = 0
    while lo < len(arr):
        start = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of documents: byte ranges, 64-bit ids, and bounds[i]:bounds[i+1] of document i."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    prefix: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def range_ids(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return range_ids(self.prefix, starts, ends)

    def per_doc(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a per-word number over each document."""
        total = np.concatenate([[0], np.cumsum(per_word)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def per_doc_bytes(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def range_ids(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(arr: pa.LargeStringArray, lower: bool = False) -> Words:
    buf, offsets = raw(arr)
    n = len(buf)
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw, _ = _powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[buf] * pw[:n], out=prefix[1:])
    bounds = np.searchsorted(starts, offsets)
    return Words(buf, offsets, starts, ends, range_ids(prefix, starts, ends), bounds, prefix)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word window and the index of its first word; windows never cross documents."""
    n = len(w.ids)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9FB21C651E98DF25) + w.ids[i : n - k + 1 + i]
    doc = w.doc
    ok = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    return mix(h[ok]), ok


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each document, concatenated, and their bounds by document.

    A document of 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    h, at = windows(w, k)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = []
        for i in short:
            x = np.uint64(w.counts[i])
            for v in w.ids[w.bounds[i] : w.bounds[i + 1]]:
                x = np.uint64((int(x) * 0x9FB21C651E98DF25 + int(v)) & 0xFFFFFFFFFFFFFFFF)
            extra.append(x)
        h = np.concatenate([h, mix(np.array(extra, np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(w.bounds)))


def lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newline-split lines that hold a word: document, hash, and number of bytes."""
    buf, offsets = w.buf, w.offsets
    nl = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], nl + 1]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    doc = np.searchsorted(offsets, starts, "right") - 1
    stop = offsets[doc + 1]
    following = np.append(nl, len(buf))[np.searchsorted(nl, starts)]
    ends = np.minimum(stop, following)
    held = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, doc = starts[held], ends[held], doc[held]
    return doc, w.range_ids(starts, ends), ends - starts


def repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key): whether it occurs twice or more in its document, and whether it is a later occurrence."""
    if not len(key):
        z = np.zeros(0, bool)
        return z, z
    k = key ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.empty(len(s), bool), np.empty(len(s), bool)
    out[order], later[order] = twice, same
    return out, later


def repeat_words(w: Words, k: int = 3) -> np.ndarray:
    """Per document: words covered by k-word windows that occur twice or more in it, first occurrences included."""
    h, at = windows(w, k)
    covered = np.zeros(len(w.ids), bool)
    if len(h):
        twice, _ = repeats(w.doc[at], h)
        for i in range(k):
            covered[at[twice] + i] = True
    return w.per_doc(covered.astype(np.int64))


def dup_lines(w: Words) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    doc, h, _ = lines(w)
    _, later = repeats(doc, h)
    return np.bincount(doc[later], minlength=len(w.bounds) - 1) if len(doc) else np.zeros(len(w.bounds) - 1, np.int64)
