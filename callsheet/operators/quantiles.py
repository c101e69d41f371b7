"""Exact quantiles (linear interpolation) without gathering a group.

Spark's exact ``percentile`` keeps a value -> count map per group, so a
continuous column in one big group lands in one task. Here every needed
order statistic is found by narrowing a value interval pass by pass:

1. one aggregate gives per group n, min and max; the order statistics for
   each probability p are ranks floor(h) + 1 and ceil(h) + 1 with
   h = (n - 1) p (the same rule as SQL ``quantile_cont``);
2. each pass scans the rows inside the open intervals (a broadcast of the
   small target table), histograms them into 65,536 equal-width buckets per
   target with the bucket's real min / max, and keeps the bucket holding the
   wanted rank -- the histogram, not the rows, is shuffled;
3. a target is settled when its interval holds one distinct value or at
   most ``max_rows`` rows; those few rows are ranked with a window.

Groups that hold at most ``max_rows`` rows in total skip the narrowing and
use Spark's exact ``percentile`` directly: its value map is then bounded.

Work per pass is one filtered scan; the number of passes is small (each
cuts the interval 65,536-fold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.session import broadcast_if_small, persist

BUCKETS = 65536
MAX_ROWS = 200_000
MAX_PASSES = 12


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    buckets: int = BUCKETS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(keys..., p, q): exact quantiles of ``value`` per key group."""
    keys = list(keys)
    plist = [float(p) for p in probs]

    def by_percentile(frame: DataFrame) -> DataFrame:
        return (frame.groupBy(*keys).agg(F.percentile("_v", plist).alias("_qs"))
                .select(*keys, F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in plist]).alias("p"),
                                                     F.col("_qs").alias("q")))))

    base = persist(df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()))
    # groups of at most max_rows rows: Spark's exact percentile, whose value
    # map is then bounded by max_rows; only bigger groups are narrowed
    stats = persist(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_mn"),
                                            F.max("_v").alias("_mx")))
    figures = stats
    if stats.where(F.col("_n") > max_rows).isEmpty():
        out = by_percentile(base).checkpoint()
        base.unpersist()
        figures.unpersist()
        return out
    small_keys = broadcast_if_small(stats.where(F.col("_n") <= max_rows).select(*keys))
    small = by_percentile(base.join(small_keys, keys))
    stats = stats.where(F.col("_n") > max_rows)
    h = (F.col("_n") - 1) * F.col("_p")
    wanted = (stats.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
              .withColumn("_h", h)
              .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor(h) + 1, F.ceil(h) + 1))))
              .select(*keys, "_p", "_h", F.col("_r").cast("long").alias("_r"), "_mn", "_mx", "_n"))
    wanted = persist(wanted)
    # one search state per distinct (keys, rank): interval [lo, hi], rows below lo
    state = (wanted.select(*keys, "_r", "_mn", "_mx", "_n").distinct()
             .select(*keys, "_r", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"),
                     F.lit(0).cast("long").alias("_below"), F.col("_n").cast("long").alias("_cnt"))).checkpoint()
    settled = None
    span = [*keys, "_lo", "_hi", "_below"]      # an interval of a group
    for _ in range(MAX_PASSES):
        done = state.where((F.col("_lo") == F.col("_hi")) | (F.col("_cnt") <= max_rows))
        settled = done if settled is None else settled.unionByName(done)
        open_ = state.where(~((F.col("_lo") == F.col("_hi")) | (F.col("_cnt") <= max_rows)))
        if open_.isEmpty():
            state = None
            break
        # ranks that search the same interval share its histogram
        t = broadcast_if_small(open_.select(*span).distinct())
        width = (F.col("_hi") - F.col("_lo")) / F.lit(float(buckets))
        rows = (base.join(t, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                .withColumn("_b", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))))
        hist = rows.groupBy(*span, "_b").agg(
            F.count(F.lit(1)).alias("_bn"), F.min("_v").alias("_bmn"), F.max("_v").alias("_bmx"))
        wcum = Window.partitionBy(*span).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_bn").over(wcum), F.lit(0)))
        pick = hist.join(broadcast_if_small(open_.select(*span, "_r")), span).where((F.col("_before") < F.col("_r")) & (F.col("_r") <= F.col("_before") + F.col("_bn")))
        state = pick.select(*keys, "_r", F.col("_bmn").alias("_lo"), F.col("_bmx").alias("_hi"),
                            F.col("_before").alias("_below"), F.col("_bn").alias("_cnt")).checkpoint()
    if state is not None:                       # out of passes: rank what is left
        settled = settled.unionByName(state)
    settled = settled.checkpoint()
    # exact value of every settled rank: constant interval, or rank the few rows
    const = settled.where(F.col("_lo") == F.col("_hi")).select(*keys, "_r", F.col("_lo").alias("_val"))
    few = settled.where(F.col("_lo") != F.col("_hi"))
    ft = broadcast_if_small(few.select(*span).distinct())
    w = Window.partitionBy(*span).orderBy("_v")
    ranked = (base.join(ft, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
              .withColumn("_pos", F.col("_below") + F.row_number().over(w))
              .join(broadcast_if_small(few.select(*span, "_r")), span)
              .where(F.col("_pos") == F.col("_r")).select(*keys, "_r", F.col("_v").alias("_val")))
    values = const.unionByName(ranked).checkpoint()     # met twice below
    lo_v = values.select(*keys, F.col("_r").alias("_r1"), F.col("_val").alias("_v1"))
    hi_v = values.select(*keys, F.col("_r").alias("_r2"), F.col("_val").alias("_v2"))
    out = (wanted.select(*keys, "_p", "_h").distinct()
           .withColumn("_r1", (F.floor("_h") + 1).cast("long")).withColumn("_r2", (F.ceil("_h") + 1).cast("long"))
           .join(lo_v, keys + ["_r1"]).join(hi_v, keys + ["_r2"])
           .select(*keys, F.col("_p").alias("p"),
                   (F.col("_v1") + (F.col("_h") - F.floor("_h")) * (F.col("_v2") - F.col("_v1"))).alias("q")))
    out = out.unionByName(small).checkpoint()          # small result; frees the working copies
    base.unpersist()
    wanted.unpersist()
    figures.unpersist()
    return out


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                     names: Sequence[str]) -> DataFrame:
    """Exact quantiles pivoted to one column per probability: (keys..., names...)."""
    q = exact_quantiles(df, keys, value, probs)
    aggs = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*keys).agg(*aggs)
