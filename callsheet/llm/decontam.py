"""Benchmark decontamination: a broadcast hash set of the benchmark's word
n-grams, scanned over the documents' windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A
window is ``n`` consecutive words of one item; an item of fewer words (but not
none) is one window. Windows meet by a 64-bit hash first; every meeting is
verified on the words themselves, so hash collisions can't show in a result.

The documents are scanned where they lie: no shuffle, no collect. The
benchmark is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows and
``BLOCK_BYTES`` bytes, whatever its size; a larger benchmark means further
scans, each over all documents, that add to the hits of the one before.

Defined cases: a null or empty text has no words and no hits; benchmark items
without words have no window; a null ``item_id`` still hits words but is not
listed; repeated items and repeated documents each get their own row's result;
an empty benchmark hits nothing; input columns named like an output are
replaced by it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames
from callsheet.llm.words import ALNUM, LOWER, ragged, runs, slices, window_hashes, words

N = 10
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 16 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ADDED = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType())}
_WINDOWS = "length int, hash long, words binary, item string"


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """(length, hash, words, item): the distinct windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            w = words(part.column("text"), ALNUM, LOWER)
            ids = part.column("item").to_pylist()
            seen = set()
            for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                k = min(n, b - a)
                for i in range(a, b - k + 1) if k else ():
                    seen.add((k, int(window_hashes(w.hash[i:i + k], k)[0].astype(np.int64)), w.joined(i, i + k), ids[d]))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("length", "hash", "words", "item"), x)) for x in seen],
                pa.schema([("length", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())]))

    src = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("text"))
    return src.mapInArrow(cut, _WINDOWS).distinct()


def _blocks(windows: DataFrame) -> Iterator[dict]:
    """The windows as {length: {hash: {words: [item, ...]}}}, a bounded part of
    the hash space at a time."""
    size = windows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("words") + 32).alias("b")).first()
    parts = max(-(-size.n // BLOCK_WINDOWS), -(-(size.b or 0) // BLOCK_BYTES), 1)
    for k in range(parts):
        found: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        part = windows if parts == 1 else windows.where(F.pmod("hash", F.lit(parts)) == k)
        for length, h, text, item in part.toLocalIterator():
            found[length][h & (2**64 - 1)][bytes(text)].append(item)
        yield {length: {h: dict(x) for h, x in by.items()} for length, by in found.items()}


def _scan(docs: DataFrame, text: str, block: dict) -> DataFrame:
    """Add the hits of one block of windows to ``hit_spans``, ``hit_items``."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = docs.schema
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        keys = {}
        for length, by in table.items():
            hashes = np.fromiter(by, np.uint64, len(by))
            few = np.zeros(1 << 20, bool)  # by the low bits: passes all of the set and little else
            few[hashes & np.uint64((1 << 20) - 1)] = True
            keys[length] = (np.sort(hashes), few)
        for part in slices(batches, text):
            w = words(part.column(text), ALNUM, LOWER)
            hit = np.zeros(len(w.start) + 1, np.int64)
            items = [set(x or ()) for x in part.column("hit_items").to_pylist()]
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), part.column("hit_spans").to_pylist())):
                for span in b or ():
                    hit[a + span["start"]] += 1
                    hit[a + span["end"]] -= 1
            doc = w.doc
            for length, (hashes, few) in keys.items():
                h = window_hashes(w.hash, length)
                at = w.windows(length)
                at = at[few[h[at] & np.uint64((1 << 20) - 1)]]
                at = at[np.isin(h[at], hashes)]
                for i, value, d in zip(at.tolist(), h[at].tolist(), doc[at].tolist()):
                    found = table[length][value].get(w.joined(i, i + length))
                    if found is not None:
                        hit[i] += 1
                        hit[i + length] -= 1
                        items[d].update(x for x in found if x is not None)
            covered = np.cumsum(hit[:-1]) > 0
            spans, counts = [], np.zeros(len(items), np.int64)
            for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                if covered[a:b].any():
                    s, e = runs(covered[a:b])
                    counts[d] = len(s)
                    spans += [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())]
            cols = dict(zip(part.schema.names, part.columns))
            cols["n_words"] = pa.array(w.n, pa.int64())
            cols["hit_spans"] = ragged(pa.array(spans, pa.struct([("start", pa.int32()), ("end", pa.int32())])), counts)
            cols["hit_items"] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", n: int = N, remove: str = "none") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges, end excluded) and
    ``hit_items`` (ids of the items with occurring windows, sorted as text).

    ``remove``: ``none`` keeps all rows and texts; ``documents`` drops the rows
    with a hit; ``spans`` cuts the hit words (and what stands between them)
    out of the texts and drops rows that have no word left of some before.
    """
    windows = frames.stored(benchmark_windows(benchmark, item, item_text, n), "windows")
    out = frames.without(docs, list(ADDED))
    for name, kind in ADDED.items():
        out = out.withColumn(name, F.lit(None).cast(kind))
    blocks = _blocks(windows)
    more = next(blocks)
    while more is not None:
        out = _scan(out, text, more)
        more = next(blocks, None)
        if more is not None:
            out = frames.stored(out, "decontaminated")  # one block in memory at a time
    frames.drop_stored(windows)
    if remove == "documents":
        return out.where(F.size("hit_spans") == 0)
    if remove == "spans":
        return _cut(out, text).where((F.size("hit_spans") == 0) | (F.col("n_words") > F.aggregate(
            "hit_spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])))
    return out


def _cut(docs: DataFrame, text: str) -> DataFrame:
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            cols = dict(zip(part.schema.names, part.columns))
            spans = part.column("hit_spans").to_pylist()
            w = words(part.column(text), ALNUM, LOWER)
            raw = part.column(text).to_pylist()
            base = np.cumsum([0] + [len((x or "").encode()) for x in raw]).tolist()
            for d, cuts in enumerate(spans):
                if cuts:
                    old, new, at = raw[d].encode(), [], 0
                    for x in cuts:
                        new.append(old[at:int(w.start[w.first[d] + x["start"]]) - base[d]])
                        at = int(w.end[w.first[d] + x["end"] - 1]) - base[d]
                    raw[d] = b"".join([*new, old[at:]]).decode()
            cols[text] = pa.array(raw, pa.string())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(cut, docs.schema)
