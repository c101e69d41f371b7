"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

A window is ``WIDTH`` bytes of one text (UTF-8). The first document (by id) in
which its bytes start keeps it; in all others the bytes it covers go. Windows
are judged on the input.

1. Windows go to buckets by their minimiser, the smallest hash among their
   runs of ``GRAM`` bytes; consecutive windows that share it travel as one
   string. So equal windows meet, and no bucket needs a whole text. Of equal
   strings (byte by byte) only those of the smallest id count, in a slice and
   again in a bucket; the others are lost for certain.
2. A bucket leaves out the strings whose minimiser no other document has. The
   others are cut, whole minimisers together, into parts of bounded size, and
   those into shards.
3. Each shard gets its transform: its suffixes in the order of their first
   ``WIDTH`` bytes, and for each the symbols before it. A symbol is 8 bytes.
4. The transforms are merged by refining their interleave: from an interleave
   that is right for d bytes, writing every suffix's preceding symbol and
   sorting by it, stably, gives the one for d + 8. Suffixes are in one block
   while their common prefix is at least d. Six rounds and one of two bytes
   give the blocks of suffixes that share ``WIDTH`` bytes: the repeated
   intervals. No suffix is compared with another, and no shard is sorted again.
5. What is lost goes back to its document as byte ranges. A task sends the
   ranges of many documents as one row to their receiver, so rows do not grow
   with documents times buckets.

A minimiser of more bytes than a part (a passage that very many documents
share) is settled in parts by ascending id: what is left of one part, once
each, is a shard of the next. Buckets are sized from the input's bytes; a
bucket past ``CHUNK`` first gives up its equal strings.

Defined cases: null and empty texts have no bytes, texts under ``WIDTH`` bytes
no window; ids are integers, a null id counts as larger than all others; rows
of one id count as one document, so they lose nothing to each other; a window
that repeats inside one document is kept there or removed throughout; removal
may cut a character, so what is kept is binary; input columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames
from callsheet.llm.phrases import take_ranges
from callsheet.llm.words import buffers, mix, ragged, runs, slices

WIDTH, GRAM = 50, 16
SLICE, GATHER, CHUNK = 1 << 20, 8 << 20, 48 << 20
#: bytes of strings in a bucket, of a part that is merged at once, of a shard
BUCKET, PART, SHARD = 16 << 20, 1 << 20, 1 << 18
#: windows of a string at most
LONGEST = 60_000
LAST = 2**63 - 1
_SENT = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("texts", pa.binary()), ("meta", pa.binary()),
                   ("n_docs", pa.int32()), ("docs", pa.binary()), ("id", pa.int64()), ("hash", pa.int64()), ("lost", pa.list_(pa.int64()))])
_SENT_DDL = "bucket int, n int, size int, texts binary, meta binary, n_docs int, docs binary, id long, hash long, lost array<long>"
#: ranges that tasks send to their documents: those of one receiver are one row
_LOST = pa.schema([("to", pa.int32()), ("n", pa.int32()), ("ranges", pa.binary())])
_LOST_DDL = "to int, n int, ranges binary"
_FOUND = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("lost", pa.list_(pa.int64()))])
#: ranges that a task holds before it sends them on
HELD = 1 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_LOW = np.uint64(0xFFFFFFFF)
#: bits of a minimiser that travel; two that share them are taken for one, at the cost of work
_KEY = np.uint64(0xFFFFFF)
_ZSTD = 5


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as a number in the bytes' order; the text is a ring."""
    n = len(buf)
    ring = np.concatenate((buf, buf[:16], np.zeros(16, np.uint8)))
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        m = (n - o + 7) // 8
        out[o::8] = ring[o:o + 8 * m].view(">u8")
    return out


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense rank of every position from its place in sorted keys."""
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], (sorted_keys[1:] != sorted_keys[:-1]).view(np.uint8)))).astype(np.uint64)
    return out


@dataclass
class Shard:
    """Transform of a ring of at most 2 million bytes: its suffixes in the
    order of ``WIDTH`` bytes, and what stands before each."""
    order: np.ndarray
    symbols: np.ndarray   # distinct 8-byte symbols, sorted
    before: np.ndarray    # rank in ``symbols`` of the 8 bytes before each suffix
    pair: np.ndarray      # the 2 bytes before each suffix

    @classmethod
    def of(cls, buf: np.ndarray, width: int = WIDTH) -> Shard:
        n, bits = len(buf), np.uint64(21)
        key = eights(buf)
        order = np.argsort(key)
        ranked = key[order]
        rank = first = _ranks(ranked, order)
        symbols = ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]
        here, known = np.arange(n, dtype=np.uint64), 8
        while known < width:
            step = min(known, width - known)
            packed = np.sort(rank << (bits + bits) | np.roll(rank, -step) << bits | here)
            order = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
            rank = _ranks(packed >> bits, order)
            known += step
        return cls(order, symbols, first[order - 8], (key[order - 2] >> np.uint64(48)).astype(np.uint64))


def merge(shards: list[Shard], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each place, block of each place) of the merged order: places
    of one block share ``width`` bytes. The k-th place of a shard is its k-th suffix."""
    symbols = np.sort(np.concatenate([s.symbols for s in shards]))
    symbols = symbols[np.concatenate(([True], symbols[1:] != symbols[:-1]))]
    before = np.concatenate([np.searchsorted(symbols, s.symbols).astype(np.uint64)[s.before] for s in shards])
    pair = np.concatenate([s.pair for s in shards])
    of = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    block = np.zeros(len(of), np.int32)
    here = np.arange(len(of), dtype=np.uint64)
    written = np.empty(len(of), np.uint64)
    for step in [pair] * (width % 8 // 2) + [before] * (width // 8):
        written[np.argsort(of, kind="stable")] = step
        packed = np.sort(written << np.uint64(32) | here)
        at = (packed & _LOW).astype(np.int64)
        symbol = packed >> np.uint64(32)
        of, block = of[at], block[at]
        new = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.concatenate(([0], np.cumsum(new, dtype=np.int32))).astype(np.int32)
    return of, block


@dataclass
class Strings:
    """Strings of a bucket: bytes one after another, minimiser, owner and
    place in its text of each."""
    text: np.ndarray
    offs: np.ndarray
    key: np.ndarray
    doc: np.ndarray    # row of ``ids``
    at: np.ndarray
    ids: np.ndarray
    hashes: np.ndarray

    def take(self, which: np.ndarray) -> Strings:
        text, offs = take_ranges(self.text, self.offs[which], self.offs[which + 1])
        return Strings(text, offs, self.key[which], self.doc[which], self.at[which], self.ids, self.hashes)

    @property
    def id(self) -> np.ndarray:
        return self.ids[self.doc]

    @staticmethod
    def together(parts: list[Strings]) -> Strings:
        sizes = np.concatenate([np.diff(p.offs) for p in parts])
        base = np.cumsum([0, *[len(p.ids) for p in parts[:-1]]])
        return Strings(np.concatenate([p.text for p in parts]), np.concatenate(([0], np.cumsum(sizes))),
                       *(np.concatenate(x) for x in ([p.key for p in parts], [p.doc + b for p, b in zip(parts, base)], [p.at for p in parts],
                                                     [p.ids for p in parts], [p.hashes for p in parts])))


def settle(s: Strings, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(lost, first) by byte of the strings: whether a window that starts there
    also starts in a smaller id; whether it stands for all equal ones."""
    pad = np.zeros(64, np.uint8)
    cuts = np.searchsorted(s.offs, np.arange(SHARD, int(s.offs[-1]), SHARD), "right") - 1
    cuts = np.unique(np.concatenate(([0], cuts, [len(s.offs) - 1])))
    shards, where = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = np.concatenate((s.text[s.offs[a]:s.offs[b]], pad))
        shards.append(Shard.of(part, width))
        where.append(np.concatenate((np.arange(s.offs[a], s.offs[b]), np.full(64, -1))))
    of, block = merge(shards, width)
    place = np.empty(len(of), np.int64)
    place[np.argsort(of, kind="stable")] = np.concatenate([w[x.order] for w, x in zip(where, shards)])
    owner = np.repeat(np.arange(len(s.offs) - 1), np.diff(s.offs))
    window = np.zeros(len(s.text) + 1, bool)  # the last stands for the padding
    window[:-1] = np.arange(len(s.text)) + width <= s.offs[owner + 1]
    ok = window[place]
    place, block = place[ok], block[ok]
    lost, first = np.zeros(len(s.text), bool), np.zeros(len(s.text), bool)
    if len(place):
        head = np.concatenate(([True], block[1:] != block[:-1]))
        heads, group = np.flatnonzero(head), np.cumsum(head) - 1
        own = s.id[owner[place]]
        least = np.minimum.reduceat(own, heads)[group]
        lost[place] = own != least
        stays = np.flatnonzero(own == least)
        first[place[stays[np.unique(group[stays], return_index=True)[1]]]] = True
    return lost, first


def _replies(doc: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, hashes: np.ndarray, bucket: int) -> pa.RecordBatch:
    """Lost byte ranges, one row a document; a range is start * 2^32 + end."""
    by = np.argsort(doc, kind="stable")
    doc, spans = doc[by], (start[by].astype(np.int64) << 32) | end[by].astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    n, counts = len(heads), np.diff(np.append(heads, len(doc)))
    none, zero = pa.nulls(n, pa.binary()), pa.array(np.zeros(n), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket), pa.int32()), zero, zero, none, none, zero, none, pa.array(ids[doc[heads]], pa.int64()),
                                       pa.array(hashes[doc[heads]], pa.int64()), ragged(pa.array(spans), counts)], schema=_SENT)


def _ranges(s: Strings, mask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, end in its text) of the bytes that marked windows cover, string by string."""
    edge = np.zeros(len(mask), bool)
    edge[s.offs[:-1]] = True
    a, b = runs(mask)  # windows never end a string, so no run crosses two
    of = np.searchsorted(s.offs, a, "right") - 1
    return of, s.at[of] + a - s.offs[of], s.at[of] + b - 1 - s.offs[of] + width


def equal_strings(total: np.ndarray, begin: np.ndarray, end: np.ndarray, text: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which strings equal (byte by byte) one of a smaller id; equal strings have equal totals."""
    lost = np.zeros(len(total), bool)
    order = np.argsort(total)
    heads = np.flatnonzero(np.concatenate(([True], total[order[1:]] != total[order[:-1]])))
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    least = np.minimum.reduceat(ids[order], heads)[group] if len(order) else order
    stays = np.flatnonzero(ids[order] == least)
    first = order[stays[np.unique(group[stays], return_index=True)[1]]][group]
    maybe = np.flatnonzero((ids[order] != least) & ((end - begin)[order] == (end - begin)[first]))
    for lo in range(0, len(maybe), 20_000):
        x = maybe[lo:lo + 20_000]
        mine, other = order[x], first[x]
        a, offs = take_ranges(text, begin[mine], end[mine])
        b, _ = take_ranges(text, begin[other], end[other])
        lost[mine] = np.add.reduceat(a != b, offs[:-1]) == 0
    return lost


def _totals(k: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number of every string that equal strings share."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(k), dtype=np.uint64)))
    return mix(sums[end - 7] - sums[begin] + key * np.uint64(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:len(v) - step], v[step:])
        have += step
    return v


def cut(buf: np.ndarray, offs: np.ndarray, k: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, minimiser, text) of the longest runs of windows of one
    text that share their minimiser; ``k`` holds the eights."""
    n = len(buf)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, np.empty(0, np.uint64), none
    grams = mix(k[:n - GRAM + 1] + mix(k[8:n - GRAM + 9]))
    low = _least(grams, width - GRAM + 1)
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    ok = doc[:n - width + 1] == doc[width - 1:]
    head = ok.copy()
    head[1:] &= (low[1:] != low[:-1]) | ~ok[:-1] | (doc[1:n - width + 1] != doc[:n - width])
    begin = np.flatnonzero(head)
    stop = np.flatnonzero(ok & np.concatenate((~ok[1:] | head[1:], [True]))) + 1
    if len(begin) and (stop - begin).max() > LONGEST:
        more = (stop - begin + LONGEST - 1) // LONGEST
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        begin, stop = np.repeat(begin, more) + nth * LONGEST, np.repeat(stop, more)
        stop = np.minimum(stop, begin + LONGEST)
    return begin, stop + width - 1, low[begin], doc[begin].astype(np.int64)


def _planes(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c.astype(np.int64).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)


def _long_planes(c: np.ndarray) -> bytes:
    return np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _packed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=_ZSTD).compress(raw, asbytes=True)


def _send(buckets: int, width: int):

    def flush(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The strings of some slices, bucket by bucket."""
        bytes_, rows_ = (np.cumsum([0, *[len(g[i]) for g in got]])[:-1] for i in (0, 1))
        buf, ids, hashes = (np.concatenate([g[i] for g in got]) for i in range(3))
        begin, end, doc = (np.concatenate([g[i] + o for g, o in zip(got, base)]) for i, base in ((3, bytes_), (4, bytes_), (5, rows_)))
        low, total, at = (np.concatenate([g[i] for g in got]) for i in (6, 7, 8))
        lost = equal_strings(total, begin, end, buf, ids[doc])
        bucket = ((low >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        if lost.any():
            yield _replies(doc[lost], at[lost], at[lost] + (end - begin)[lost], ids, hashes, int(bucket[0]))
        by = np.flatnonzero(~lost)
        by = by[np.argsort((bucket[by] << 32) | begin[by])]   # in the texts' order, whose steps are small
        cuts = np.flatnonzero(np.diff(bucket[by])) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(by)]) if len(by) else ():
            x = by[a:b]
            text = take_ranges(buf, begin[x], end[x])[0].tobytes()
            own, mine = np.unique(doc[x], return_inverse=True)
            meta = _planes(low[x] & _KEY, end[x] - begin[x], np.diff(mine, prepend=0), np.diff(at[x], prepend=0))
            rows.append({"bucket": int(bucket[x[0]]), "n": len(x), "size": len(text), "texts": _packed(text), "meta": _packed(meta), "n_docs": len(own),
                         "docs": _packed(_long_planes(np.diff(ids[own], prepend=0)) + hashes[own].tobytes())})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for part in slices(batches, "text", SLICE):
            buf, offs = buffers(part.column("text"))
            k = eights(buf)
            begin, end, low, doc = cut(buf, offs, k, width)
            if not len(begin):
                continue
            got.append((buf, part.column("id").to_numpy(), part.column("hash").to_numpy(), begin, end, doc, low, _totals(k, begin, end, low), begin - offs[doc]))
            size += len(buf)
            if size > GATHER:
                yield from flush(got)
                got, size = [], 0
        if got:
            yield from flush(got)
    return send


def _read(batch: pa.RecordBatch, i: int) -> Strings:
    n, size = batch.column("n")[i].as_py(), batch.column("size")[i].as_py()
    text = pa.decompress(batch.column("texts")[i].as_buffer(), decompressed_size=size, codec="zstd")
    meta = np.frombuffer(pa.decompress(batch.column("meta")[i].as_buffer(), decompressed_size=16 * n, codec="zstd"), np.uint8).reshape(4, 4, n)
    meta = [np.ascontiguousarray(m.T).view("<u4").reshape(n) for m in meta]
    m = batch.column("n_docs")[i].as_py()
    docs = np.frombuffer(pa.decompress(batch.column("docs")[i].as_buffer(), decompressed_size=16 * m, codec="zstd"), np.uint8)
    ids = np.cumsum(np.ascontiguousarray(docs[:8 * m].reshape(8, m).T).view("<i8").reshape(m))
    return Strings(np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(meta[1], dtype=np.int64))), meta[0].astype(np.uint64),
                   np.cumsum(meta[2].view(np.int32), dtype=np.int64), np.cumsum(meta[3].view(np.int32), dtype=np.int64), ids, docs[8 * m:].view(np.int64))


def _shared(s: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Strings whose minimiser more than one id has, by minimiser, and how many each such one has."""
    order = np.argsort(s.key, kind="stable")
    key, ids = s.key[order], s.id[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    shared = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    counts = np.diff(np.append(heads, len(key)))
    return order[np.repeat(shared, counts)], counts[shared]


def _merged(s: Strings, width: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lost ranges (document, start, end) of a bucket."""
    s = s.take(_shared(s)[0])
    if not len(s.key):
        return
    s, gone = _collapsed(s)
    yield gone
    order, counts = _shared(s) if len(s.key) else (s.key, s.key)
    if not len(order):
        return
    upto = np.cumsum((s.offs[1:] - s.offs[:-1])[order])
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(order):
        done = upto[begin - 1] if begin else 0
        g = int(np.searchsorted(upto[ends - 1], done + part, "right"))
        end = int(ends[g - 1]) if g and ends[g - 1] > begin else int(ends[np.searchsorted(ends, begin, "right")])
        which = order[begin:end]
        if upto[end - 1] - done <= part:
            x = s.take(np.sort(which))
            lost, _ = settle(x, width)
            of, a, b = _ranges(x, lost, width)
            yield x.doc[of], a, b
        else:  # one minimiser of many strings: by ascending id, what came first is a shard of the next part
            yield from _by_id(s, which, width, part)
        begin = end


def _by_id(s: Strings, which: np.ndarray, width: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    which = which[np.argsort(s.id[which], kind="stable")]
    sizes = np.cumsum((s.offs[1:] - s.offs[:-1])[which])
    left = None
    for a, b in _cuts(sizes, part):
        new = s.take(which[a:b])
        x = new if left is None else Strings.together([left, Strings(new.text, new.offs, new.key, new.doc, new.at, s.ids, s.hashes)])
        base = 0 if left is None else len(left.ids)
        lost, first = settle(x, width)
        of, lo, hi = _ranges(x, lost, width)
        yield x.doc[of] - base, lo, hi  # what is left has smaller ids, or the same one, and loses nothing
        of, lo, hi = _ranges(x, first, width)
        begin = lo - x.at[of] + x.offs[of]
        text, offs = take_ranges(x.text, begin, begin + hi - lo)
        kept_ids = x.id[of]
        left = Strings(text, offs, x.key[of], np.arange(len(of)), lo, kept_ids, np.zeros(len(of), np.int64))


def _cuts(upto: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def _collapsed(s: Strings) -> tuple[Strings, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings without those that equal one of a smaller id, and the ranges of these."""
    lost = equal_strings(_totals(eights(s.text), s.offs[:-1], s.offs[1:], s.key), s.offs[:-1], s.offs[1:], s.text, s.id)
    gone = np.flatnonzero(lost)
    return s.take(np.flatnonzero(~lost)), (s.doc[gone], s.at[gone], s.at[gone] + s.offs[gone + 1] - s.offs[gone])


def _sent_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], receivers: int) -> pa.RecordBatch:
    """Held ranges, one row a receiver; a document has one receiver."""
    ids, hashes, spans = (np.concatenate(x) for x in zip(*held))
    to = ((mix(hashes.view(np.uint64) + mix(ids.view(np.uint64))) >> np.uint64(32)) % np.uint64(receivers)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[by])) + 1
    rows = [(int(to[x[0]]), len(x), _packed(ids[x].tobytes() + hashes[x].tobytes() + spans[x].tobytes())) for x in np.split(by, cuts) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 3, _LOST.types)], schema=_LOST)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges by document; the rows of a receiver come one after another."""

    def flush(got: list[np.ndarray]) -> pa.RecordBatch:
        ids, hashes, spans = np.concatenate(got, axis=1)
        by = np.lexsort((hashes, ids))
        ids, hashes = ids[by], hashes[by]
        heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(hashes[heads]), ragged(pa.array(spans[by]), np.diff(np.append(heads, len(ids))))], schema=_FOUND)
    now, got = None, []
    for batch in batches:
        for to, n, packed in zip(batch.column("to").to_pylist(), batch.column("n").to_pylist(), batch.column("ranges")):
            if to != now and got:
                yield flush(got)
                got = []
            now = to
            got.append(np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=24 * n, codec="zstd"), np.int64).reshape(3, n))
    if got:
        yield flush(got)


def _settle(width: int, part: int, chunk: int, receivers: int):
    """Settles the buckets of a partition, which come one after another. A
    document loses ranges in many buckets, so these go on together."""

    def flush(pending: list[Strings]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        s = Strings.together(pending)
        for doc, start, end in _merged(s, width, part):
            yield s.ids[doc], s.hashes[doc], (start.astype(np.int64) << 32) | end.astype(np.int64)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        now, pending, size, bound = None, [], 0, chunk
        for batch in batches:
            n = batch.column("n").to_numpy()
            if (n == 0).any():
                known = batch.filter(pa.array(n == 0))
                lost = known.column("lost")
                many = lost.value_lengths().to_numpy(zero_copy_only=False)
                yield np.repeat(known.column("id").to_numpy(), many), np.repeat(known.column("hash").to_numpy(), many), lost.flatten().to_numpy()
            for i in np.flatnonzero(n).tolist():
                bucket = batch.column("bucket")[i].as_py()
                if bucket != now:
                    if pending:
                        yield from flush(pending)
                    now, pending, size, bound = bucket, [], 0, chunk
                pending.append(_read(batch, i))
                size += len(pending[-1].text)
                if size > bound:
                    left, (doc, start, end) = _collapsed(Strings.together(pending))
                    yield left.ids[doc], left.hashes[doc], (start.astype(np.int64) << 32) | end.astype(np.int64)
                    pending, size = [left], len(left.text)
                    bound = max(chunk, 2 * size)
        if pending:
            yield from flush(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for got in settled(batches):
            held.append(got)
            size += len(got[0])
            if size > HELD:
                yield _sent_on(held, receivers)
                held, size = [], 0
        if size:
            yield _sent_on(held, receivers)
    return run


def lost_ranges(docs: DataFrame, id_col: str, text: str, width: int = WIDTH, bucket: int = BUCKET, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """(id, hash, lost): per document (id and hash of its text) the ranges that
    it loses. Documents that lose nothing have no row."""
    parts = frames.partitions(docs.sparkSession)
    src = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(docs[text]).alias("hash"), docs[text].alias("text"))
    # a string of w windows is w + WIDTH - 1 bytes, and holds half as many windows as a minimiser has places
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = 1 + 2 * (width - 1) / (width - GRAM + 1)
    buckets = max(parts, int(total * spread) // bucket + 1)
    sent = src.mapInArrow(_send(buckets, width), _SENT_DDL)
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(width, part, chunk, buckets), _LOST_DDL)
    return found.repartition(parts, "to").sortWithinPartitions("to").mapInArrow(_gather, "id long, hash long, lost array<long>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bucket: int = BUCKET, part: int = PART,
                   chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (byte ranges, end excluded) and
    ``kept_bytes`` (the others, concatenated)."""
    out = frames.without(docs, ["n_bytes", "removed", "kept_bytes", "_lost", "_id", "_hash"])
    lost = frames.stored(lost_ranges(out, id_col, text, width, bucket, part, chunk), "ranges", free=True).toDF("_id", "_hash", "_lost")
    mine = (F.coalesce(out[id_col].cast("long"), F.lit(LAST)) == F.col("_id")) & (F.xxhash64(out[text]) == F.col("_hash"))
    joined = out.join(lost, mine, "left").select(*[F.col(f"`{c}`") for c in out.columns], "_lost")
    schema = frames.with_fields(out, n_bytes=T.LongType(), removed=SPANS, kept_bytes=T.BinaryType())
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            buf, offs = buffers(part.column(text))
            gone, lost = np.zeros(len(buf) + 1, np.int32), part.column("_lost")
            for d in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)).tolist():
                spans = lost[d].values.to_numpy()
                np.add.at(gone, offs[d] + (spans >> 32), 1)
                np.add.at(gone, offs[d] + (spans & 0xFFFFFFFF), -1)
            gone = np.cumsum(gone[:-1]) > 0
            own = np.repeat(np.arange(part.num_rows), np.diff(offs))
            a = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1] | (own[1:] != own[:-1]))))
            b = np.flatnonzero(gone & np.concatenate((~gone[1:] | (own[1:] != own[:-1]), [True]))) + 1
            counts = np.bincount(own[a], minlength=part.num_rows)
            start = offs[own[a]]
            spans = pa.StructArray.from_arrays([pa.array((a - start).astype(np.int32)), pa.array((b - start).astype(np.int32))], ["start", "end"])
            kept = np.concatenate(([0], np.cumsum(np.bincount(own[~gone], minlength=part.num_rows)))).astype(np.int32)
            cols = dict(zip(part.schema.names, part.columns))
            cols["n_bytes"] = pa.array(np.diff(offs), pa.int64())
            cols["removed"] = ragged(spans, counts)
            cols["kept_bytes"] = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(buf[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return joined.mapInArrow(apply, schema)
