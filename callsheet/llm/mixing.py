"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash. A source whose target is t times its size is
taken floor(t) times as a whole; of the rest, the rows with the smallest hashes
are taken once more, up to the word budget that is left. The hash threshold is
found without sorting rows: words are summed by source and hash bucket, a
running sum over the buckets finds the one that holds the budget, and only the
rows of that bucket are summed again by the next bits. Rows are then filtered
by comparing their hash with their source's threshold. Thresholds are nested:
a larger budget takes all that a smaller one takes.

What grows with the input is one compact table (source, words, hash), the
histograms (sources x 4,096 rows at most) and one row per source; all stay
DataFrames. Only scalars reach the driver. A hot source is summed map-side and
its rows are never gathered.

Defined cases: a null source is a source of its own, last in order; a null or
empty text has size 0; rows with equal ids hash alike and are taken or left
together (a null id hashes its text); no rows give no rows; input columns named
like an output are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm import frames

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BITS, STEP = 60, 12


def row_hash(id_col: Column, text: Column, seed: int = 0) -> Column:
    """60 bits of md5 of the seed and the id (its text for a null id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Sources by code point (null last) take the weights in turn and share
    ``share`` times the sum of all sizes; no target exceeds ``cap`` times its
    size, and the excess is shared by weight among the others until none does.
    The running rank is a range sort with counts per partition; each round of
    sharing is one aggregate, so any number of sources will do.
    """
    ordered = frames.stored(sizes.orderBy(F.col("source").isNull(), "source")
                            .withColumn("at", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("part")).count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    turn = F.pmod(F.col("before") + within, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = ordered.join(F.broadcast(before.select(F.col("part"), "before")), part == F.col("part")) \
        .select("source", "source_size", weight.alias("weight"))
    ranked = frames.stored(ranked, "weights")
    frames.drop_stored(ordered)
    full = F.lit(float(cap)) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    rate = 0.0
    last = -1
    while True:
        got = ranked.agg(F.sum(F.when(capped, F.col("source_size"))).alias("held"),
                         F.sum(F.when(~capped, F.col("weight"))).alias("open"),
                         F.count(F.when(capped, 1)).alias("n")).first()
        if got.n == last or not got.open:
            break
        last = got.n
        rate = (share * total - cap * (got.held or 0)) / got.open
        capped = F.lit(rate) * F.col("weight") > full
    target = F.least(F.lit(rate) * F.col("weight"), full) if rate else full
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``copies`` of all rows, and ``below``: rows whose hash is
    under it are taken once more.

    ``rows``: (source, size, h). The threshold falls between two rows of the
    source so that the words taken come as near the budget as they can.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.select("*", times.cast("int").alias("copies")) \
        .withColumn("extra", F.col("target") - F.col("copies") * F.col("source_size")) \
        .select("source", "copies", "extra", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"),
                F.when(F.col("extra") <= 0, F.lit(0).cast("long")).alias("below"))
    state = frames.stored(state, "state")
    for level in range(BITS // STEP):
        opened = state.where("below IS NULL")
        if opened.isEmpty():
            break
        left = BITS - STEP * (level + 1)
        sides = rows.alias("r").join(
            opened.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright("r.h", left + STEP) == F.col("s.prefix")))
        hist = sides.groupBy("s.source", "s.copies", "s.extra", "s.before", F.shiftright("r.h", left).alias("bucket")) \
            .agg(F.sum("r.size").alias("size"), F.min("r.h").alias("lo"), F.max("r.h").alias("hi"))
        w = Window.partitionBy("source").orderBy("bucket")  # 4,096 rows of a source at most
        to = F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        # the bucket in which the budget ends; a bucket of one hash value is settled at once
        edge = hist.withColumn("to", to).where((F.col("to") > F.col("extra")) & (F.col("to") - F.col("size") <= F.col("extra")))
        near = F.when(2 * F.col("to") - F.col("size") <= 2 * F.col("extra"), F.col("hi") + 1).otherwise(F.col("lo"))
        found = edge.select("source", "copies", "extra", F.col("bucket").alias("prefix"),
                            (F.col("to") - F.col("size")).alias("before"),
                            F.when(F.col("lo") == F.col("hi"), near).cast("long").alias("below"))
        more = frames.stored(state.where("below IS NOT NULL").unionByName(found), "state")
        frames.drop_stored(state)
        state = more
    return state.select("source", "copies", "below")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (words that
    the source should give) and ``copies`` (how often the mix takes the row)."""
    out = frames.without(docs, ["size", "source_size", "target", "copies"])
    h = row_hash(out[id_col], out[text], seed)
    rows = frames.stored(out.select(out[source].alias("source"), frames.n_words(text).alias("size"), h.alias("h")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = frames.stored(source_targets(sizes, weights, share, cap), "targets")
    plan = thresholds(rows, targets).alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))) \
        .select(F.col("t.source").alias("_source"), "source_size", "target", F.col("copies").alias("_copies"), "below")
    plan = frames.stored(plan, "plan")
    plan = frames.small(plan, F.length(F.coalesce("_source", F.lit(""))) * 4 + 64)
    frames.drop_stored(rows)
    return out.join(plan, out[source].eqNullSafe(F.col("_source"))) \
        .select(*[out[f"`{c}`"] for c in out.columns], frames.n_words(text).alias("size"), "source_size", "target",
                (F.col("_copies") + (h < F.col("below")).cast("int")).alias("copies"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row as often as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))) \
        .select(*columns)
