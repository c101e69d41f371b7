"""Vectorised words of Arrow text columns, for use inside Spark tasks.

A text is cut into words at separator bytes; every word is a byte span of the
column's UTF-8 buffer with a 64-bit hash. Nothing here knows about Spark: the
operators call it from ``mapInArrow`` on one slice of one batch at a time, so
memory follows ``limit``, not the partition (a text longer than ``limit``
makes a slice of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
LONG_WORD = 256

_blank = np.zeros(256, bool)
_blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes of words ``[^\x20\x09-\x0D]+``
PLAIN = ~_blank
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo:_hi + 1] = True
#: A-Z to a-z, all else unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME, _BASIS = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    offs = offs.astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold at most ``limit`` bytes together,
    or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of several texts in order. ``first[d]:first[d + 1]`` are those of
    text d; ``buf`` holds the (folded) bytes that the spans point into."""
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n)

    def windows(self, k: int) -> np.ndarray:
        """Positions where k consecutive words of one text start."""
        if len(self.start) < k:
            return np.empty(0, np.int64)
        doc = self.doc
        return np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])

    def joined(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by one space."""
        raw = self.buf
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """FNV-1a of each span with a final mix, all spans byte by byte at once;
    the few spans over ``LONG_WORD`` bytes take BLAKE2b one by one."""
    size = end - start
    order = np.argsort((LONG_WORD + 1 - np.minimum(size, LONG_WORD + 1)).astype(np.uint16), kind="stable")
    at, size = start[order], size[order]
    n_long = int(np.count_nonzero(size > LONG_WORD))
    h = np.full(len(at), _BASIS, np.uint64)
    if len(size) > n_long:
        most = int(size[n_long])
        more_than = len(size) - np.cumsum(np.bincount(size[n_long:], minlength=most + 1))
        for k in range(most):
            m = int(more_than[k])
            part = h[n_long:m]
            part ^= buf[at[n_long:m] + k]
            part *= _PRIME
    h = mix(h)
    for i in range(n_long):
        word = buf[at[i]:at[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    out = np.empty_like(h)
    out[order] = h
    return out


def words(col: pa.Array, is_word: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of every text of a column; ``is_word`` says which bytes belong to
    words, ``fold`` maps bytes first (for lower-casing)."""
    return words_of(*buffers(col), is_word, fold)


def words_of(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """The same for texts that lie in ``buf`` at ``offs``."""
    if fold is not None:
        buf = fold[buf]
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        return Words(buf, none, none, np.zeros(len(offs), np.int64), np.empty(0, np.uint64))
    inside = is_word[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(buf, start, end, np.searchsorted(start, offs), word_hashes(buf, start, end))


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of k hashes (runs may cross texts; see Words.windows)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            power = power * base
            out += h[j:len(h) - k + 1 + j] * power
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def ragged(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """List column whose row i holds the next counts[i] values."""
    offs = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), values)
