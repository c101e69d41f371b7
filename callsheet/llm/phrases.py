r"""Phrases whose words stay together, mined over a prefix-free parse.

Texts are lower-cased (A-Z) and split at ``[.,;:!?\x0A-\x0D]`` into pieces and
those into words ``[^\x20\x09]+``; all counts are per language.

1. Parse: a window of ``MOST - 1`` words whose hash is 0 modulo ``TRIGGER``
   starts a new chunk, and the chunk before it reaches to that window's end. So
   chunks depend on content alone, equal passages give equal chunks, and every
   phrase of up to ``MOST`` words lies inside the chunk where it starts. The
   dictionary is the distinct chunks with the times that each occurs.
2. Counting runs over the dictionary, weighted. A chunk counts the phrases
   that start at its own words, not those that start in the overlap.
3. A phrase of ``a`` occurrences has parts of at least ``a``, so phrases that
   are rarer than ``least`` leave early: words, then pairs are counted by hash,
   and the hashes that reach ``least`` set bits of a fixed ``SLOTS``-bit map
   (so many bits / 8 bytes reach the driver and the tasks, at every size). A
   bit may be set by another phrase: such phrases are counted, then dropped.
4. What is left is counted by its words, exactly, then cut, scored, compared
   with the longer phrases around it and ranked.

Defined cases: null and empty texts have no words; a null language is ``und``,
together with texts that are marked so; phrases never cross pieces or texts;
repeated rows count again; ties of score and count go by the phrase's bytes;
an empty table has no phrases; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm import frames, tallies
from callsheet.llm.words import LOWER, Words, buffers, mix, slices, window_hashes, words_of

MOST = 4
LEAST = 30
TOP = 2000
TRIGGER = 32
SLICE = 4 << 20
#: bits of a level's map: 8 MB, whatever the input
SLOTS = 1 << 26
SALTS = 64
#: bytes of text for one bucket of an exchange
BUCKET = 16 << 20
SCORE, INSIDE = 2_000_000, 80

#: bytes that end a piece, and bytes of words
CUT = np.zeros(256, bool)
CUT[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
IN_WORD = ~CUT
IN_WORD[[0x20, 0x09]] = False


def take_ranges(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ranges one after another, and the offsets between them."""
    offs = np.concatenate(([0], np.cumsum(end - begin)))
    return buf[np.repeat(begin - offs[:-1], end - begin) + np.arange(offs[-1])], offs


def strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))


def canonical(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each begins (one more at the end)."""
    size = w.end - w.start
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = take_ranges(w.buf, w.start, w.end)[0]
    return out, at


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, k, n): the chunks of every text; k words of each start phrases."""
    overlap = MOST - 1
    for part in slices(batches, "text", SLICE):
        w = words_of(*buffers(part.column("text")), IN_WORD, LOWER)
        n = len(w.start)
        if not n:
            continue
        doc, cuts = w.doc, np.concatenate(([0], np.cumsum(CUT[w.buf])))[w.start]
        piece = np.cumsum(np.concatenate(([True], (np.diff(cuts) != 0) | (np.diff(doc) != 0)))) - 1
        head = np.concatenate(([True], np.diff(piece) != 0))
        if n > overlap:
            inside = piece[:n - overlap + 1] == piece[overlap - 1:]
            head[:n - overlap + 1] |= inside & (window_hashes(w.hash, overlap, seed=3) % np.uint64(TRIGGER) == 0)
        start = np.flatnonzero(head)
        after = np.append(start[1:], n)
        stop = np.append(np.flatnonzero(np.diff(piece)) + 1, n)[piece[start]]
        end = np.where(after < stop, after + overlap, stop)
        yield _texts(*canonical(w), start, end, part.column("lang").take(pa.array(doc[start])), after - start, np.ones(len(start), np.int64))


def _texts(text: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, lang: pa.Array, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Runs of words, each ended by a newline, with two numbers."""
    data, offs = take_ranges(text, at[start], at[end])
    data[offs[1:] - 1] = 0x0A
    return pa.RecordBatch.from_arrays([lang, strings(data, offs), pa.array(k.astype(np.int32)), pa.array(n)], ["lang", "text", "k", "n"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 8) -> DataFrame:
    """Distinct chunks (lang, text, k) of all texts and their number n; the
    phrases of a chunk start at its first k words."""
    src = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    return tallies.by_text(src, _parse, buckets)


class _Grams:
    """Phrases of a slice of the dictionary: ``ok(n)`` says at which words
    phrases of n words start, ``keys(n)`` holds their hashes by language."""

    def __init__(self, part: pa.RecordBatch):
        self.w = words_of(*buffers(part.column("text")), IN_WORD)
        doc = self.w.doc
        place = np.arange(len(doc)) - self.w.first[:-1][doc]
        self.left = self.w.n[doc] - place
        self.own = place < part.column("k").to_numpy()[doc]
        self.freq = part.column("n").to_numpy()[doc]
        coded = part.column("lang").dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy()[doc]
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
        self.seed = np.array(seeds, np.uint64)[self.lang] if len(doc) else np.empty(0, np.uint64)

    def keys(self, n: int) -> np.ndarray:
        h = window_hashes(self.w.hash, n)
        out = np.zeros(len(self.left), np.uint64)
        out[:len(h)] = mix(h ^ self.seed[:len(h)])
        return out

    def starts(self, n: int) -> np.ndarray:
        return self.own & (self.left >= n)


def _shifted(ok: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(ok), bool)
    out[:len(ok) - by] = ok[by:]
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - tallies.KEY_BITS) & np.uint64(SLOTS - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, heads, sums) of equal keys."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return order, heads, np.add.reduceat(weight[order], heads)


def _by_hash(n: int, bits: list[np.ndarray]):
    """Phrases of n words by hash; with the map of single words, only pairs of such."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices(batches, "text", SLICE):
            g = _Grams(part)
            ok = g.starts(n)
            if bits:
                one = _in(bits[0], g.keys(1))
                ok &= one & _shifted(one, 1)
            if ok.any():
                yield g.keys(n)[ok], g.freq[ok]
    return count


def _by_words(bits: list[np.ndarray]):
    """(lang, text, k, n): phrases whose words and pairs are all in the maps."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            g = _Grams(part)
            if not len(g.left):
                continue
            text, at = canonical(g.w)
            one, two = _in(bits[0], g.keys(1)), _in(bits[1], g.keys(2))
            two &= one & _shifted(one, 1)
            for n in range(1, MOST + 1):
                ok = g.starts(n) & (one if n == 1 else two)
                for by in range(1, n - 1):
                    ok &= _shifted(two, by)
                where = np.flatnonzero(ok)
                if not len(where):
                    continue
                keys, size = g.keys(n)[where], at[where + n] - at[where]
                order, heads, sums = _summed(keys, g.freq[where])
                group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
                first = order[heads]
                # equal hashes of unequal size or start: two phrases, left apart
                odd = (size[order] != size[first][group]) | (text[at[where[order]]] != text[at[where[first]]][group])
                if odd.any():
                    first, sums = order, g.freq[where][order]
                start = where[first]
                yield _texts(text, at, start, start + n, g.langs.take(pa.array(g.lang[start])), np.full(len(first), n), sums)
    return count


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The fixed map of the given hashes."""
    slot = F.col("key").bitwiseAND(SLOTS - 1) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in parts.collect():
        at = (r.b - 1) * len(r.bits)
        out[at:at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def phrase_counts(chunks: DataFrame, least: int = LEAST, buckets: int = 8) -> DataFrame:
    """(lang, phrase, k, f): all phrases of up to ``MOST`` words with f >= ``least``."""
    bits: list[np.ndarray] = []
    for n in (1, 2):
        bits.append(_bitmap(tallies.by_hash(chunks, _by_hash(n, list(bits)), buckets, least)))
    return tallies.by_text(chunks, _by_words(bits), buckets, least).withColumnsRenamed({"text": "phrase", "n": "f"})


def _exact(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that
    no longer one mostly contains; ``counts`` is read several times."""
    words = F.split("phrase", " ")
    many = counts.where("k > 1").withColumnRenamed("f", "a")
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("_l"),
                     F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_r"))
    for side in ("l", "r"):
        part = counts.select("lang", F.col("phrase").alias(f"_{side}"), F.col("f").alias(side))
        cut = cut.join(part, ["lang", f"_{side}"])
    score = F.expr(f"(cast({SCORE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    inner = F.expr(f"flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    around = counts.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    got = best.join(around, ["lang", "phrase"], "left")
    free = F.col("_longer").isNull() | (_exact("_longer") * 100 < _exact("a") * INSIDE)
    return got.where(free).select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a (its
    count), l and r (those of the parts at its lowest cut), n (words of the
    language) and score = floor(2,000,000 a / (l + r))."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(frames.partitions(docs.sparkSession), total // BUCKET + 1)
    chunks = frames.stored(dictionary(docs, text, lang, buckets), "chunks", free=True)
    counts = frames.stored(phrase_counts(chunks, least, buckets), "phrases", free=True)
    # first the best of every salt, so that no language is ranked in one task
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored(counts).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    window = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))
    few = salted.withColumn("_at", window).where(F.col("_at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    total = chunks.groupBy("lang").agg(F.sum(F.col("k") * F.col("n")).alias("n"))
    out = frames.stored(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    frames.drop_stored(chunks)
    frames.drop_stored(counts)
    return out
