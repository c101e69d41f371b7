"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of a document. The first document (by id)
in which a window's word sequence starts keeps it; in all others the words it
covers are removed. Windows are judged on the input.

1. Every task settles its own slice of documents: of equal windows the one in
   the smallest document stays, the others are lost for certain. So a passage
   that a third of all documents share leaves a slice once.
2. The remaining windows go to buckets by their minimiser, the smallest hash
   among their runs of ``m`` words. Consecutive windows share it mostly, so
   they travel together as one packed string (a super-k-mer); strings for the
   same bucket are compressed together.
3. Every bucket sorts its windows and settles them for good, in chunks of
   bounded size: only windows that are still first stay in memory.
4. What is lost comes back as (document, window hashes); each document removes
   the words that its lost windows cover.

Windows meet by a 64-bit hash when sorted, and every meeting is verified on
the words themselves.

Defined cases: null and empty texts have no words, and a text of fewer than k
words no window; ids are integers, a null id counts as larger than all others;
rows of one id count as one document, so repeated rows lose nothing to each
other; a window that repeats inside one document is kept there or removed
throughout; input columns named like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames
from callsheet.llm.words import PLAIN, Words, ragged, runs, slices, window_hashes, words, words_of

K, M = 13, 3
SLICE, CHUNK = 8 << 20, 24 << 20
BUCKETS_PER_PARTITION = 4
LAST = 2**63 - 1
_SENT = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("texts", pa.binary()),
                   ("ids", pa.binary()), ("id", pa.int64()), ("lost", pa.list_(pa.int64()))])
_SENT_DDL = "bucket int, n int, size int, texts binary, ids binary, id long, lost array<long>"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def settle(w: Words, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, lost, first) of all windows; ``ids`` by text.
    Lost: an equal window is in a text of smaller id. First: it is the one of
    its equals that stands for them (the others of its id are neither)."""
    at = w.windows(k)
    h = window_hashes(w.hash, k)[at]
    got = _settle(w, ids, k, at, h)
    if got is None:  # two different windows with one hash: compare the words instead
        known: dict[bytes, int] = {}
        got = _settle(w, ids, k, at, np.array([known.setdefault(w.joined(p, p + k), len(known)) for p in at.tolist()]))
    return at, h, *got


def _settle(w: Words, ids: np.ndarray, k: int, at: np.ndarray, h: np.ndarray):
    lost, first = np.zeros(len(at), bool), np.ones(len(at), bool)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return lost, first
    shared = np.zeros(len(at), bool)
    shared[1:] |= same
    shared[:-1] |= same
    begins = ~np.concatenate(([False], same))[shared]
    idx = order[shared]
    heads = np.flatnonzero(begins)
    group = np.cumsum(begins) - 1
    own = ids[w.doc[at[idx]]]
    least = np.minimum.reduceat(own, heads)[group]
    if not _equal(w, at[idx[heads]][group], at[idx], k):
        return None
    lost[idx] = own != least
    first[idx] = False
    stays = np.flatnonzero(own == least)
    first[idx[stays[np.unique(group[stays], return_index=True)[1]]]] = True
    return lost, first


def _equal(w: Words, left: np.ndarray, right: np.ndarray, k: int) -> bool:
    """Whether the windows at ``left`` and ``right`` have equal words, pair by
    pair; runs of neighbouring pairs are compared at once."""
    by = np.argsort(right, kind="stable")
    left, right = left[by], right[by]
    cut = np.flatnonzero((np.diff(right) != 1) | (np.diff(left) != 1)) + 1
    raw = w.buf
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(left)]):
        x, y, n = int(left[a]), int(right[a]), b - a + k - 1
        if x != y and raw[w.start[x]:w.end[x + n - 1]].tobytes() != raw[w.start[y]:w.end[y + n - 1]].tobytes() \
                and w.joined(x, x + n) != w.joined(y, y + n):
            return False
    return True


def _replies(ids: np.ndarray, hashes: np.ndarray, bucket: int) -> pa.RecordBatch:
    """Lost windows as one row per id."""
    by = np.argsort(ids, kind="stable")
    ids, hashes = ids[by], hashes[by]
    heads = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
    n, counts = len(heads), np.diff(np.append(heads, len(ids)))
    none, zero = pa.nulls(n, pa.binary()), pa.array(np.zeros(n), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, bucket), pa.int32()), zero, zero, none, none,
         pa.array(ids[heads], pa.int64()), ragged(pa.array(hashes.view(np.int64)), counts)], schema=_SENT)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:len(v) - step], v[step:])
        have += step
    return v


def super_kmers(w: Words, at: np.ndarray, alive: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, minimiser) of the longest runs of alive windows of one
    text that share their minimiser."""
    at = at[alive]
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    low = _least(window_hashes(w.hash, m, seed=2), k - m + 1)[at]
    doc = w.doc[at]
    head = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc) != 0) | (low[1:] != low[:-1])))
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(at)) - 1
    return at[heads], at[tails] + k, low[heads]


def _pack(bucket: int, raw: bytes, begin: list[int], end: list[int], ids: np.ndarray) -> dict:
    texts = b"\n".join([raw[a:b] for a, b in zip(begin, end)])
    return {"bucket": bucket, "n": len(ids), "size": len(texts), "texts": pa.compress(texts, codec="zstd", asbytes=True),
            "ids": pa.compress(np.diff(ids, prepend=0).tobytes(), codec="zstd", asbytes=True)}


def _send(buckets: int, k: int, m: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            w = words(part.column("text"), PLAIN)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            at, h, lost, first = settle(w, ids, k)
            doc = w.doc
            if lost.any():
                yield _replies(ids[doc[at[lost]]], h[lost], int(ids[0] % buckets))
            begin, end, low = super_kmers(w, at, first & ~lost, k, m)
            to = (low % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            begin, end, to = begin[by], end[by], to[by]
            raw = np.where(PLAIN[w.buf], w.buf, np.uint8(0x20)).tobytes()
            cuts = np.flatnonzero(np.diff(to)) + 1
            rows = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)]) if len(to) else ():
                rows.append(_pack(int(to[a]), raw, w.start[begin[a:b]].tolist(), w.end[end[a:b] - 1].tolist(),
                                  ids[doc[begin[a:b]]]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SENT)
    return send


def _count(k: int):
    """Settles the buckets of a partition, which come one after another."""

    def merge(pending: list[tuple[bytes, np.ndarray]]):
        texts = b"\n".join(t for t, _ in pending)
        ids = np.concatenate([x for _, x in pending])
        buf = np.frombuffer(texts, np.uint8)
        w = words_of(buf, np.concatenate(([0], np.flatnonzero(buf == 0x0A) + 1, [len(buf)])), PLAIN)
        at, h, lost, first = settle(w, ids, k)
        doc = w.doc
        stay = np.zeros(len(w.start), bool)
        stay[at[first & ~lost]] = True
        a, b = runs(stay)  # windows of two texts are never neighbours
        left = b"\n".join([texts[s:e] for s, e in zip(w.start[a].tolist(), w.end[b + k - 2].tolist())])
        return _replies(ids[doc[at[lost]]], h[lost], 0), (left, ids[doc[a]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pending, size = None, [], 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            if (n == 0).any():
                yield batch.filter(pa.array(n == 0))
            for i in np.flatnonzero(n).tolist():
                bucket, raw = batch.column("bucket")[i].as_py(), batch.column("size")[i].as_py()
                if len(pending) > 1 and (bucket != now or size > CHUNK):
                    lost, left = merge(pending)
                    yield lost
                    pending, size = [left] if len(left[1]) else [], 0
                if bucket != now:
                    now, pending, size = bucket, [], 0
                texts, ids = (pa.decompress(batch.column(c)[i].as_buffer(), decompressed_size=s, codec="zstd", asbytes=True)
                              for c, s in (("texts", raw), ("ids", 8 * int(n[i]))))
                pending.append((texts, np.cumsum(np.frombuffer(ids, np.int64))))
                size += raw
        if len(pending) > 1:
            yield merge(pending)[0]
    return count


def lost_windows(docs: DataFrame, id_col: str, text: str, k: int = K, m: int = M) -> DataFrame:
    """(id, lost): per document the hashes of its windows that also start in a
    document of smaller id. Documents that lose nothing have no row."""
    parts = frames.partitions(docs.sparkSession)
    src = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("id"), docs[text].alias("text"))
    sent = src.mapInArrow(_send(parts * BUCKETS_PER_PARTITION, k, m), _SENT_DDL)
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(k), _SENT_DDL)
    return found.groupBy("id").agg(F.flatten(F.collect_list("lost")).alias("lost"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, m: int = M) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` (word ranges, end excluded) and
    ``kept_text`` (the other words, joined by one space)."""
    out = frames.without(docs, ["n_words", "removed", "kept_text", "_lost"])
    lost = frames.stored(lost_windows(out, id_col, text, k, m), "lost")
    lost = lost.withColumnsRenamed({"id": "_id", "lost": "_lost"})
    joined = out.join(lost, F.coalesce(out[id_col].cast("long"), F.lit(LAST)) == F.col("_id"), "left").drop("_id")
    joined = joined.select(*[F.col(f"`{c}`") for c in out.columns], "_lost")
    schema = frames.with_fields(out, n_words=T.LongType(), removed=SPANS, kept_text=T.StringType())
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            w = words(part.column(text), PLAIN)
            at = w.windows(k)
            h = window_hashes(w.hash, k)[at]
            doc = w.doc
            edge = np.searchsorted(at, w.first)
            gone = np.zeros(len(w.start) + 1, np.int64)
            lost, kept = part.column("_lost"), []
            spans, counts = [], np.zeros(part.num_rows, np.int64)
            for d in range(part.num_rows):
                a, b = int(w.first[d]), int(w.first[d + 1])
                if lost[d].is_valid:
                    own = at[edge[d]:edge[d + 1]]
                    hit = own[np.isin(h[edge[d]:edge[d + 1]], lost[d].values.to_numpy().view(np.uint64))]
                    gone[hit] += 1
                    gone[hit + k] -= 1
                    s, e = runs(np.cumsum(gone[a:b]) > 0)
                    gone[b] = 0  # what ends with this text is no part of the next
                    counts[d] = len(s)
                    spans += [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
                    parts = [w.joined(a + x, a + y) for x, y in zip([0, *e.tolist()], [*s.tolist(), b - a]) if x < y]
                    kept.append(b" ".join(parts).decode())
                else:
                    kept.append(w.joined(a, b).decode())
            cols = dict(zip(part.schema.names, part.columns))
            cols["n_words"] = pa.array(w.n, pa.int64())
            cols["removed"] = ragged(pa.array(spans, pa.struct([("start", pa.int32()), ("end", pa.int32())])), counts)
            cols["kept_text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return joined.mapInArrow(apply, schema)
