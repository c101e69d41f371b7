"""Counting by key across tasks with packed rows.

What a task counts is combined there, ordered, compressed and sent as one row
a bucket, so that the shuffle carries compressed runs, not a row a key. A
task combines at most ``FLUSH`` bytes at once; a bucket combines what has come
whenever that doubles, so it holds its distinct keys and not their copies.
Buckets are sized by the caller from the input's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from callsheet.llm import frames
from callsheet.llm.words import buffers

FLUSH = 24 << 20
#: bits of the keys that are counted by hash: equal hashes only make a count too large
KEY_BITS = 40
_DDL = "bucket int, lang string, n int, blob binary, size int"
_SENT = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int32()), ("blob", pa.binary()), ("size", pa.int32())])


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of longs as their byte planes, which compress well when the numbers are small."""
    return b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _longs(raw: bytes | memoryview, n: int, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(raw, np.uint8, 8 * n * columns).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<i8").reshape(n) for p in planes]


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(batch: pa.RecordBatch, i: int) -> bytes:
    return pa.decompress(batch.column("blob")[i].as_buffer(), decompressed_size=batch.column("size")[i].as_py(), codec="zstd", asbytes=True)


def _runs(v: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(v)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)]) if len(v) else iter(())


# ------------------------------------------------------------ by hash

def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(n[order], heads)


def by_hash(df: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int,
            least: int) -> DataFrame:
    """(key): the hashes (``KEY_BITS`` bits) whose counts reach ``least``.
    ``produce`` turns batches of ``df`` into (uint64 keys, long counts)."""
    shift = np.uint64(64 - KEY_BITS)

    def flush(got: list) -> Iterator[pa.RecordBatch]:
        keys, n = _summed(*(np.concatenate(x) for x in zip(*got)))
        bucket = (keys * np.uint64(buckets) >> np.uint64(KEY_BITS)).astype(np.int64)
        rows = []
        for a, b in _runs(bucket):
            raw = _planes(np.diff(keys[a:b].view(np.int64), prepend=0), n[a:b])
            rows.append({"bucket": int(bucket[a]), "lang": None, "n": b - a, "blob": _packed(raw), "size": len(raw)})
        yield pa.RecordBatch.from_pylist(rows, _SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for keys, n in produce(batches):
            got.append(_summed(keys >> shift, n))
            size += 16 * len(got[-1][0])
            if size > FLUSH:
                yield from flush(got)
                got, size = [], 0
        if got:
            yield from flush(got)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(got: list) -> Iterator[pa.RecordBatch]:
            if got:
                keys, n = _summed(*(np.concatenate(x) for x in zip(*got)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least])], ["key"])
        now, got, size, bound = None, [], 0, FLUSH
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    yield from done(got)
                    now, got, size, bound = bucket, [], 0, FLUSH
                steps, n = _longs(_unpacked(batch, i), batch.column("n")[i].as_py(), 2)
                got.append((np.cumsum(steps), n))
                size += 16 * len(n)
                if size > bound:
                    got = [_summed(*(np.concatenate(x) for x in zip(*got)))]
                    size = 16 * len(got[0][0])
                    bound = max(FLUSH, 2 * size)
        yield from done(got)

    return _exchanged(df, send, buckets).mapInArrow(settle, "key long")


def _exchanged(df: DataFrame, send, buckets: int) -> DataFrame:
    parts = min(frames.partitions(df.sparkSession), buckets)
    return df.mapInArrow(send, _DDL).repartition(parts, "bucket").sortWithinPartitions("bucket")


# ------------------------------------------------------------ by text

_TEXTS = ["lang", "text", "k", "n"]


def _combined(got: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(got).group_by(["lang", "text", "k"], use_threads=False).aggregate([("n", "sum")])
    return t.select(["lang", "text", "k", "n_sum"]).rename_columns(_TEXTS)


def _bucket_of(text: pa.Array, buckets: int) -> np.ndarray:
    """A bucket by the text alone, equal in every task."""
    from callsheet.llm.words import word_hashes
    buf, offs = buffers(text)
    return (word_hashes(buf, offs[:-1], offs[1:]) % np.uint64(buckets)).astype(np.int64)


def by_text(df: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int, least: int = 1) -> DataFrame:
    """(lang, text, k, n): texts with counts of at least ``least``. ``produce``
    gives batches (lang, text, k int, n long); texts end with a newline and
    hold no other, and lose it here."""

    def flush(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _combined(got).combine_chunks()
        lang, text, k, n = (t.column(c).chunk(0) if t.column(c).num_chunks else t.column(c).combine_chunks() for c in _TEXTS)
        codes = lang.dictionary_encode()
        by = pc.sort_indices(text).to_numpy()   # neighbours share their beginnings
        place = _bucket_of(text, buckets)[by] * len(codes.dictionary) + codes.indices.to_numpy()[by]
        then = np.argsort(place, kind="stable")
        by, place = by[then], place[then]
        text, k, n = text.take(pa.array(by)), k.to_numpy()[by], n.to_numpy()[by]
        buf, offs = buffers(text)
        rows = []
        for a, b in _runs(place):
            raw = _planes(k[a:b], n[a:b]) + buf[offs[a]:offs[b]].tobytes()
            bucket, code = divmod(int(place[a]), len(codes.dictionary))
            rows.append({"bucket": bucket, "lang": codes.dictionary[code].as_py(), "n": b - a, "blob": _packed(raw), "size": len(raw)})
        yield pa.RecordBatch.from_pylist(rows, _SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in produce(batches):
            got.append(batch)
            size += batch.nbytes
            if size > FLUSH:
                yield from flush(got)
                got, size = [], 0
        if got:
            yield from flush(got)

    def read(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        n, raw = batch.column("n")[i].as_py(), _unpacked(batch, i)
        k, count = _longs(raw, n, 2)
        data = np.frombuffer(raw, np.uint8, offset=16 * n)
        offs = np.concatenate(([0], np.flatnonzero(data == 0x0A) + 1)).astype(np.int32)
        text = pa.StringArray.from_buffers(n, pa.py_buffer(offs), pa.py_buffer(data))
        lang = pa.array([batch.column("lang")[i].as_py()], pa.string()).take(pa.array(np.zeros(n, np.int32)))
        return pa.RecordBatch.from_arrays([lang, text, pa.array(k, pa.int32()), pa.array(count)], _TEXTS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not got:
                return
            t = _combined(got)
            t = t.filter(pc.greater_equal(t.column("n"), least)).combine_chunks()
            for out in t.to_batches(max_chunksize=100_000):
                buf, offs = buffers(out.column("text"))   # less the newlines, byte by byte: a text may be no valid UTF-8
                offs = (offs - np.arange(len(offs))).astype(np.int32)
                text = pa.StringArray.from_buffers(out.num_rows, pa.py_buffer(offs), pa.py_buffer(buf[buf != 0x0A]))
                yield pa.RecordBatch.from_arrays([text if c == "text" else out.column(c) for c in _TEXTS], _TEXTS)
        now, got, size, bound = None, [], 0, FLUSH
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now:
                    yield from done(got)
                    now, got, size, bound = bucket, [], 0, FLUSH
                got.append(read(batch, i))
                size += got[-1].nbytes
                if size > bound:
                    got = _combined(got).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in got)
                    bound = max(FLUSH, 2 * size)
        yield from done(got)

    return _exchanged(df, send, buckets).mapInArrow(settle, "lang string, text string, k int, n long")
