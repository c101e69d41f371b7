"""Quality classifier: per-document perplexity under an interpolated modified
Kneser-Ney model of trusted text, thresholded by language-specific quantiles.

The model is of characters, order 3: what marks junk is how words are written
(stray symbols, capitals, separators) as much as which follow one another, and
all its n-grams pack exactly into a long (three code points of 21 bits). It is
built from all trusted documents and scores all documents:

1. Tasks count their trigrams (trusted ones, and all others with count 0, so
   that the table covers everything that needs a probability); the counts are
   summed by trigram.
2. Continuation counts, context totals, discounts and interpolated
   probabilities are grouped sums and joins of these count tables by trigram,
   bigram and character: DataFrame work, sharded by key.
3. Documents meet the probabilities by sharded joins: a slice of documents
   sends, for every shard of the trigram space, its inverted lists (trigram ->
   documents and counts) as one compressed row; the shard holds its part of the
   table, and returns a partial log-likelihood per document. These are summed
   as integers (units of 2**-20 nats), so that any order gives the same sum.
   The number of shards follows the table, the spread over tasks the input.
4. Per language, the threshold is the quantile of the trusted documents'
   perplexity, read off an exact histogram.

Nothing is broadcast but trusted ids (if their number is within the bound that
``frames`` states; else that join is a shuffle), and only the counts of counts
and totals reach the driver.

Defined cases: a null or empty text has no perplexity and is rejected; a null
language is a language of its own; a language with fewer than ``MIN_TRUSTED``
trusted documents takes the threshold of all languages together; without any
trusted text nothing is rejected but empty texts; repeated ids and rows are
scored alike; an id is trusted if all its labels say so; a null id never is.
Input columns named like an output are replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm import frames
from callsheet.llm.words import buffers, slices

QUANTILE, MIN_TRUSTED = 0.998, 50
#: Trigrams that a shard of the probability table holds.
SHARD = 16_384
BITS = 21
CHAR, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
END, UNIT = CHAR, float(1 << 20)
SLICE, SLICE_DOCS = 2 << 20, 60_000


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts one after another, and where each text's
    begin. A text of n characters gives n + 1 (its end counts as one), each
    after two characters of context (0 before the text); an empty one none."""
    buf, offs = buffers(col)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]  # characters before each text
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    n = np.diff(heads)
    first = np.concatenate(([0], np.cumsum(np.where(n > 0, n + 3, 0))))  # two zeros, the text, its end
    full = np.zeros(first[-1], np.int64)
    full[np.arange(len(code)) + np.repeat(first[:-1] + 2 - heads[:-1], n)] = code
    full[first[1:][n > 0] - 1] = END
    grams = full[:-2] << 2 * BITS | full[1:-1] << BITS | full[2:] if len(full) else full
    starts = np.concatenate(([0], np.cumsum(np.where(n > 0, n + 1, 0))))
    place = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], np.diff(starts))
    return grams[place], starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        grams, starts = trigrams(part.column("text"))
        trusted = np.repeat(part.column("trusted").to_numpy(zero_copy_only=False), np.diff(starts))
        for got, n in (np.unique(grams[trusted], return_counts=True), (np.unique(grams[~trusted]), None)):
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(np.zeros(len(got), np.int64) if n is None else n)],
                                             ["gram", "n"])


def counts(docs: DataFrame, text: str) -> DataFrame:
    """(gram, n): every trigram of the documents and how often trusted text has it."""
    src = docs.select(docs[text].alias("text"), "trusted").where(F.length("text") > 0)
    return src.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts 1 to 4; the usual
    halves where a count of counts is missing."""
    a, b, c, d = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not a or not b or not c or not d:
        return 0.5, 1.0, 1.5
    y = a / (a + 2 * b)
    got = (1 - 2 * y * b / a, 2 - 3 * y * c / b, 3 - 4 * y * d / c)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(got, 1))


def _less(n: str, d: tuple[float, float, float]):
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _context(df: DataFrame, key, n: str, d: tuple[float, float, float], name: str) -> DataFrame:
    """Per context: its total count, and the mass that discounting leaves."""
    return df.groupBy(key.alias(name)).agg(F.sum(n).cast("double").alias(f"{name}_total"), F.sum(_less(n, d)).alias(f"{name}_mass"))


def probabilities(table: DataFrame) -> DataFrame:
    """(gram, logp): log probability of every trigram's last character after
    its first two, in units of 2**-20 nats."""
    seen = table.where("n > 0")

    def of_counts(df: DataFrame, n: str) -> tuple[float, float, float]:
        return _discounts({r[0]: r["count"] for r in df.where(F.col(n) <= 4).groupBy(n).count().collect()})

    pairs = frames.stored(seen.groupBy(F.col("gram").bitwiseAND(PAIR).alias("pair")).agg(F.count(F.lit(1)).alias("k")), "pairs")
    chars = pairs.groupBy(F.col("pair").bitwiseAND(CHAR).alias("c")).agg(F.count(F.lit(1)).alias("u"))
    d3, d2, d1 = of_counts(seen, "n"), of_counts(pairs, "k"), of_counts(chars, "u")
    one = chars.agg(F.sum("u").alias("total"), F.sum(_less("u", d1)).alias("mass")).first()
    symbols = table.select(F.col("gram").bitwiseAND(CHAR).alias("c")).distinct()
    n_symbols = symbols.count() + 1
    total, mass = one.total or 1, one.mass if one.total else 1.0
    p1 = symbols.join(chars, "c", "left").select("c", (
        F.coalesce((F.col("u") - _less("u", d1)) / F.lit(float(total)), F.lit(0.0)) + F.lit(mass / total / n_symbols)).alias("p1"))
    two = _context(pairs, F.shiftright("pair", BITS), "k", d2, "b")
    needed = table.select(F.col("gram").bitwiseAND(PAIR).alias("pair")).distinct().withColumn(
        "b", F.shiftright("pair", BITS)).withColumn("c", F.col("pair").bitwiseAND(CHAR))

    def mixed(n: str, d, ctx: str, lower: str):
        own = F.when(F.col(n) > 0, (F.col(n) - _less(n, d)) / F.col(f"{ctx}_total")).otherwise(0.0)
        left = F.coalesce(F.col(f"{ctx}_mass") / F.col(f"{ctx}_total"), F.lit(1.0))
        return own + left * F.col(lower)

    p2 = needed.join(pairs, "pair", "left").join(two, "b", "left").join(p1, "c") \
        .select("pair", mixed("k", d2, "b", "p1").alias("p2"))
    three = _context(seen, F.shiftright("gram", BITS), "n", d3, "ab")
    full = table.withColumn("pair", F.col("gram").bitwiseAND(PAIR)).withColumn("ab", F.shiftright("gram", BITS))
    return full.join(three, "ab", "left").join(p2, "pair") \
        .select("gram", F.round(F.log(mixed("n", d3, "ab", "p2")) * UNIT).cast("long").alias("logp"))


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _z(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _send(shards: int, spread: int):
    """Per slice and shard: inverted lists of the slice's trigrams."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for big in slices(batches, "text", SLICE):
            for at in range(0, big.num_rows, SLICE_DOCS):
                part = big.slice(at, SLICE_DOCS)
                key = part.column("key").to_numpy()
                number += 1
                grams, starts = trigrams(part.column("text"))
                got = [np.unique(grams[a:b], return_counts=True) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                doc = np.repeat(np.arange(len(got)), [len(g) for g, _ in got])
                gram, n = np.concatenate([g for g, _ in got]), np.concatenate([c for _, c in got])
                order = np.argsort(gram, kind="stable")  # documents stay in order under their trigram
                gram, doc, n = gram[order], doc[order], n[order]
                head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.empty(0, int)
                size = np.diff(np.append(head, len(gram)))
                shard = gram[head] % shards
                salt = int((int(key[0]) + number) % spread)
                rows = []
                for s in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == s)
                    take = np.repeat(head[own] - np.concatenate(([0], np.cumsum(size[own])[:-1])), size[own]) + np.arange(size[own].sum())
                    rows.append({"shard": s, "salt": salt, "kind": 1, "n": [len(key), len(own), len(take)],
                                 "parts": [_z(key), _z(np.diff(gram[head[own]], prepend=0)), _z(size[own].astype(np.int32)),
                                           _z(doc[take].astype(np.uint16)), _z(n[take].astype(np.uint32))]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SENT)
    return send


_SENT = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("gram", pa.int64()),
                   ("logp", pa.int64()), ("n", pa.list_(pa.int32())), ("parts", pa.list_(pa.binary()))])
_SENT_DDL = "shard int, salt int, kind int, gram long, logp long, n array<int>, parts array<binary>"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial log-likelihoods; the rows of a (shard, salt) begin with its part of the table."""
    now, grams, logps = None, [], []
    table = None
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        where = np.stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()], 1)
        at = 0
        while at < batch.num_rows:
            if kind[at] == 0:
                to = at + int(np.argmax(np.append((kind[at:] != 0) | (where[at:] != where[at]).any(1), True)))
                if now != tuple(where[at]):
                    now, grams, logps = tuple(where[at]), [], []
                grams.append(batch.column("gram").slice(at, to - at).to_numpy())
                logps.append(batch.column("logp").slice(at, to - at).to_numpy())
                table, at = None, to
                continue
            if table is None:
                gram, logp = np.concatenate(grams), np.concatenate(logps)
                order = np.argsort(gram)
                table = gram[order], logp[order]
            n, parts = batch.column("n")[at].as_py(), batch.column("parts")[at].as_py()
            key, gram, size, doc, count = (
                np.frombuffer(pa.decompress(p, decompressed_size=m * np.dtype(t).itemsize, codec="zstd", asbytes=True), t)
                for p, m, t in zip(parts, (n[0], n[1], n[1], n[2], n[2]), (np.int64, np.int64, np.int32, np.uint16, np.uint32)))
            logp = np.repeat(table[1][np.searchsorted(table[0], np.cumsum(gram))], size)
            # integer sums below 2**53 are exact in doubles
            ll = np.bincount(doc, logp * count.astype(np.float64), n[0]).astype(np.int64)
            m = np.bincount(doc, count, n[0]).astype(np.int64)
            own = m > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(ll[own]), pa.array(m[own])], ["key", "ll", "m"])
            at += 1


def row_key(docs: DataFrame, id_col: str, text: str):
    """Rows of one key have one text, so one perplexity."""
    return F.xxhash64(docs[id_col], docs[text])


def perplexities(docs: DataFrame, text: str, key: str, table: DataFrame) -> DataFrame:
    """(key, log_perplexity, n) of every text that has characters."""
    spark = docs.sparkSession
    shards = _prime(max(2, -(-table.count() // SHARD)))
    parts = frames.partitions(spark)
    spread = max(1, parts // shards)
    src = docs.select(F.col(key).alias("key"), docs[text].alias("text")).where(F.length("text") > 0)
    sent = src.mapInArrow(_send(shards, spread), _SENT_DDL)
    own = table.select(F.pmod("gram", F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("salt"), F.lit(0).alias("kind"), "gram", "logp",
                       F.lit(None).cast("array<int>").alias("n"), F.lit(None).cast("array<binary>").alias("parts"))
    met = own.unionByName(sent).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    got = met.mapInArrow(_score, "key long, ll long, m long").groupBy("key").agg(F.sum("ll").alias("ll"), F.sum("m").alias("m"))
    return got.select("key", F.round(-F.col("ll") / F.lit(UNIT) / F.col("m"), 6).alias("log_perplexity"), F.col("m").alias("n"))


def lang_thresholds(scored: DataFrame, quantile: float = QUANTILE, least: int = MIN_TRUSTED) -> DataFrame:
    """(lang, threshold): of (lang, log_perplexity, trusted) rows, the smallest
    log perplexity, in steps of 1e-4, that a share ``quantile`` of the
    trusted rows doesn't exceed. The row of a null ``any`` is all languages'."""
    # a histogram: languages x distinct steps, whatever the number of documents
    step = F.ceil(F.col("log_perplexity") * 1e4).cast("long")
    hist = scored.where("trusted AND log_perplexity IS NOT NULL").groupBy("lang", step.alias("step")).count()
    hist = hist.withColumn("any", F.explode(F.array(F.lit(False), F.lit(True)))) \
        .withColumn("lang", F.when(~F.col("any"), F.col("lang"))).groupBy("any", "lang", "step").agg(F.sum("count").alias("count"))
    w = Window.partitionBy("any", "lang")
    upto = F.sum("count").over(w.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("upto", upto).withColumn("all", F.sum("count").over(w)) \
        .where((F.col("upto") >= F.col("all") * quantile) & (F.col("any") | (F.col("all") >= least))) \
        .groupBy("any", "lang").agg((F.min("step") / 1e4).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
             label_id: str = "doc_id", label: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """(key, id, lang, trusted, log_perplexity, threshold, kept): a row per
    document; ``key`` is :func:`row_key`. Kept: perplexity within the
    language's threshold."""
    good = labels.groupBy(labels[label_id].alias("_good")).agg(F.min(label).alias("q")).where("q = 1 AND _good IS NOT NULL").select("_good")
    good = frames.small(frames.stored(good, "trusted"), F.lit(16))
    src = docs.select(row_key(docs, id_col, text).alias("key"), docs[id_col].alias("id"), docs[lang].alias("lang"), docs[text].alias("text"))
    src = src.join(good, F.col("id") == F.col("_good"), "left").withColumn("trusted", F.col("_good").isNotNull()).drop("_good")
    table = frames.stored(counts(src, "text"), "counts")
    probs = frames.stored(probabilities(table), "probabilities")
    frames.drop_stored(table)
    scores = perplexities(src, "text", "key", probs)
    keyed = src.drop("text").join(scores, "key", "left").drop("n")
    keyed = frames.stored(keyed, "scores")
    frames.drop_stored(probs)
    limits = frames.stored(lang_thresholds(keyed, quantile), "thresholds")
    row = limits.where("any").first()
    of = frames.small(limits.where("NOT any").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own")), F.lit(64))
    limit = F.coalesce(F.col("_own"), F.lit(row.threshold if row else None).cast("double"))
    return keyed.join(of, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", limit) \
        .withColumn("kept", F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= limit, F.lit(True))) \
        .select("key", "id", "lang", "trusted", "log_perplexity", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` less those that the classifier rejects. The rejected rows' keys
    are the side that may be broadcast, within bounds."""
    bad = frames.stored(classify(docs, labels, id_col, text, lang).where("NOT kept").select(F.col("key").alias("_key")).distinct(), "rejected")
    return docs.join(frames.small(bad, F.lit(16)), row_key(docs, id_col, text) == F.col("_key"), "left_anti")
