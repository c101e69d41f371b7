"""Profiling operators: projections, filters, summaries, counts, pivots,
correlations, dense counts, modes and per-segment tables.

Every operator is DataFrame -> DataFrame. Wide inputs are unpivoted once so
that all columns are summarised by one grouped aggregation (one scan, one
shuffle) instead of one job per column; map-side partial aggregation keeps
hot values from concentrating rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions.columns import col_of, safe_div, yes_no

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


# --------------------------------------------------------------------------
# projections and filters
# --------------------------------------------------------------------------

def column_roles(df: DataFrame, label: str | None = None) -> tuple[list[str], list[str]]:
    """Split columns into (categorical, numeric) by type; the label is excluded."""
    cats, nums = [], []
    for name, dtype in df.dtypes:
        if name == label:
            continue
        if dtype == "string" or dtype == "boolean":
            cats.append(name)
        elif dtype.startswith(NUMERIC_TYPES):
            nums.append(name)
    return cats, nums


def column_figures(df: DataFrame, label: str | None = None) -> DataFrame:
    """(column_name, role, n, n_distinct): role, non-null and distinct values
    of every column but the label. All columns are counted by one grouped
    aggregate of (column, value), with a row for each column of an empty table."""
    cats, nums = column_roles(df, label)
    roles = {**dict.fromkeys(cats, "categorical"), **dict.fromkeys(nums, "numeric")}
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in roles]
    values = df.select(F.inline(F.array(*rows))).groupBy("column_name", "v").agg(F.count("v").alias("n"))
    figures = values.groupBy("column_name").agg(F.sum("n").alias("n"), F.count("v").alias("n_distinct"))
    names = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("role")) for c, r in roles.items()])))
    return names.join(figures, "column_name", "left").fillna(0, ["n", "n_distinct"])


def select_features(df: DataFrame) -> DataFrame:
    """All columns but the last (the label sits last)."""
    return df.select(*df.columns[:-1])


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*cols)


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def cutoff(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Keep rows strictly below every given per-column limit (null fails)."""
    cond = None
    for c, v in limits.items():
        term = F.col(c) < F.lit(v)
        cond = term if cond is None else cond & term
    return df if cond is None else df.where(cond)


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null -> 0 in numeric columns."""
    return df.fillna(0, subset=list(cols) if cols else None)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """Attach a constant tag column."""
    return df.withColumn(name, F.lit(value))


def log_shift(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``log(x - min(x) + 1)``; the global minimum is a scalar subquery
    (one partial/final aggregate), so no join is needed."""
    lo = df.agg(F.min(col)).scalar()
    return df.withColumn(out or col, F.log(F.col(col) - lo + F.lit(1.0)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# --------------------------------------------------------------------------
# long-form helpers
# --------------------------------------------------------------------------

def _inline(rows: list[Column]) -> Column:
    return F.inline(F.array(*rows))


def unpivot_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
                   as_text: bool = True) -> DataFrame:
    """(keep..., feature, value) with one row per input row and column.

    ``as_text`` casts every value to string so mixed types share one column;
    otherwise the columns are cast to double.
    """
    vtype = "string" if as_text else "double"
    return df.select(*keep, _inline([F.struct(F.lit(c).alias("feature"), F.col(c).cast(vtype).alias("value"))
                                     for c in cols]))


def unpivot_typed(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, num_value, str_value): numbers keep numeric order,
    text stays text, so one pass covers a mixed table."""
    numeric = {n for n, t in df.dtypes if t.startswith(NUMERIC_TYPES)}
    rows = []
    for c in cols:
        if c in numeric:
            rows.append(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("num_value"),
                                 F.lit(None).cast("string").alias("str_value")))
        else:
            rows.append(F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("num_value"),
                                 F.col(c).cast("string").alias("str_value")))
    return df.select(*keep, _inline(rows))


# --------------------------------------------------------------------------
# summaries and counts
# --------------------------------------------------------------------------

QUARTILES = ([0.25, 0.5, 0.75], ["p25", "p50", "p75"])


def _with_quartiles(long: DataFrame, keys: list[str], aggs: list[Column], exact: bool) -> DataFrame:
    """Grouped aggregates plus quartiles of ``value`` per key group.

    Exact quartiles come from :func:`callsheet.operators.quantiles.exact_quantiles`
    (interval narrowing over histograms; no group is gathered in one task) and
    are joined to the one-pass aggregates on the (small) group keys;
    ``exact=False`` uses ``percentile_approx`` in the same pass.
    """
    probs, names = QUARTILES
    if not exact:
        q = F.percentile_approx(F.col("value"), probs, 10000)
        out = long.groupBy(*keys).agg(*aggs, q.alias("_q"))
        return out.select(*[c for c in out.columns if c != "_q"],
                          *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    from callsheet.operators.quantiles import quantile_columns
    main = long.groupBy(*keys).agg(*aggs)
    quart = quantile_columns(long, keys, "value", probs, names)
    return _join_groups(main, quart, keys)


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on group keys in which a null group meets itself."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = left[k].eqNullSafe(right[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def describe(df: DataFrame, cols: Sequence[str], by: str | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per
    numeric column, long form: (by?, feature, count, mean, std, min, p25, p50, p75, max)."""
    keep = [by] if by else []
    long = unpivot_values(df, cols, keep, as_text=False)
    out = _with_quartiles(long, keep + ["feature"],
                          [F.count("value").alias("count"), F.avg("value").alias("mean"),
                           F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                           F.max("value").alias("max")], exact)
    return out.select(*keep, "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count per category for every column in one pass; nulls dropped."""
    long = unpivot_values(df, cols).where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "feature", F.desc("n"), "value")


def count_by(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Count per (feature value, by value); rows with a null key dropped."""
    long = unpivot_values(df, cols, [by]).where(F.col("value").isNotNull() & F.col(by).isNotNull())
    return long.groupBy("feature", "value", by).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, cols: Sequence[str], by: str, values: Sequence) -> DataFrame:
    """Counts per (feature, value) pivoted wide over ``by``; absent = null.

    Giving the pivot values avoids Spark's extra distinct job.
    """
    long = unpivot_values(df, cols, [by]).where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").pivot(by, list(values)).agg(F.count(F.lit(1)))


def segment_rate(df: DataFrame, cols: Sequence[str], label: str = "y", positive: str = "yes") -> DataFrame:
    """Which segments convert: per (feature, value) rows, positives and rate.

    All categorical columns go through one Expand + partial aggregate, so the
    shuffle carries one row per (task, feature, value), whatever the skew.
    """
    long = (df.select(*cols, yes_no(label, positive).alias("_pos"))
            .where(F.col("_pos").isNotNull()))
    long = unpivot_values(long, cols, ["_pos"]).where(F.col("value").isNotNull())
    agg = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"),
                                               F.sum("_pos").cast("long").alias("positives"))
    return agg.withColumn("rate", safe_div(F.col("positives"), F.col("n")))


def base_rate(df: DataFrame, label: str = "y", positive: str = "yes") -> DataFrame:
    """Mean of the recoded label and the class counts, one row."""
    pos = yes_no(label, positive)
    return df.agg(F.count(label).alias("n"), F.sum(pos).cast("long").alias("positives"),
                  (F.count(label) - F.sum(pos)).cast("long").alias("negatives"),
                  F.avg(pos.cast("double")).alias("rate"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, long form (a, b, r), in one aggregate."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_c{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_c{i}").alias("r")))
        rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"_c{i}").alias("r")))
    for c in cols:
        rows.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")))
    return one.select(_inline(rows))


def dense_counts(df: DataFrame, key: str, by: str) -> DataFrame:
    """Count per (key, by) for every integer key from min to max, zero-filled,
    for every class of ``by``.

    The spine is a range of (max - min + 1) keys, made in parallel, times the
    classes (a few literals); it is outer-joined to the grouped counts. No
    cross join, no bound on the key's range.
    """
    counts = (df.where(F.col(key).isNotNull() & F.col(by).isNotNull())
              .groupBy(key, by).agg(F.count(F.lit(1)).alias("n_obs")))
    known = df.agg(F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi"), F.collect_set(by).alias("classes")).first()
    lo, hi = (known.lo, known.hi + 1) if known.lo is not None else (0, 0)
    classes = F.array(*[F.lit(c) for c in known.classes]).cast(f"array<{df.schema[by].dataType.simpleString()}>")
    spine = df.sparkSession.range(lo, hi).select(F.col("id").alias(key), F.explode(classes).alias(by))
    counts = counts.withColumn(key, F.col(key).cast("long"))
    joined = spine.join(counts, [key, by], "full_outer")
    return joined.select(key, by, F.coalesce(F.col("n_obs"), F.lit(0)).cast("long").alias("n"))


def stacked_counts(df: DataFrame, key: str, by: str, values: Sequence) -> DataFrame:
    """The dense counts as aligned series, one column per class."""
    dense = dense_counts(df, key, by)
    return dense.groupBy(key).pivot(by, list(values)).agg(F.sum("n").cast("long"))


def distribution(df: DataFrame, cols: Sequence[str], by: str, limits: Mapping[str, float] | None = None,
                 exact: bool = True) -> DataFrame:
    """Per (feature, class): n, mean, min, quartiles, max of each numeric
    column, each column cut by its own strict upper limit (others uncut)."""
    long = _cut_long(df, cols, by, limits)
    out = _with_quartiles(long, ["feature", by],
                          [F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"),
                           F.max("value").alias("max")], exact)
    return out.select("feature", by, "n", "mean", "min", "p25", "p50", "p75", "max")


def _cut_long(df: DataFrame, cols: Sequence[str], by: str, limits: Mapping[str, float] | None) -> DataFrame:
    long = unpivot_values(df, cols, [by], as_text=False).where(F.col("value").isNotNull())
    if limits:
        lim = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))])
        cap = lim[F.col("feature")]
        long = long.where(cap.isNull() | (F.col("value") < cap))
    return long


def histogram(df: DataFrame, cols: Sequence[str], by: str, bins: int = 20,
              limits: Mapping[str, float] | None = None) -> DataFrame:
    """Equal-width histogram of each numeric column per class, after cutoffs:
    (feature, class, bin, lo, hi, n). The bin edges come from a per-feature
    min/max aggregate (one row per feature, broadcast)."""
    long = _cut_long(df, cols, by, limits)
    edges = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    # one row per feature: the broadcast is bounded by the column list
    binned = (long.join(F.broadcast(edges), "feature")
              .withColumn("bin", F.when(width == 0, F.lit(0)).otherwise(
                  F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int"))
              .withColumn("lo", F.col("_lo") + F.col("bin") * width)
              .withColumn("hi", F.col("_lo") + (F.col("bin") + 1) * width))
    return binned.groupBy("feature", by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def union_groups(df: DataFrame, by: str, total_id) -> DataFrame:
    """Each row once in its own group and once in the ``total_id`` group
    (one scan; the same as unioning every group with the whole table)."""
    return df.withColumn(by, F.explode(F.array(F.col(by), F.lit(total_id).cast(df.schema[by].dataType))))


def common_features(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Per (group?, feature): the mode (ties -> smallest value) with its count,
    stacked over count / mean / std / min / quartiles / max.

    Modes come from a grouped count per (feature, value) followed by a
    ``min(struct(-n, value))`` aggregate: both stages aggregate partially on
    the map side, so no group is ever gathered into one task.
    """
    keep = [by] if by else []
    long = unpivot_typed(df, cols, keep).where(F.col("num_value").isNotNull() | F.col("str_value").isNotNull())
    counts = long.groupBy(*keep, "feature", "num_value", "str_value").agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.groupBy(*keep, "feature").agg(
        F.min(F.struct((-F.col("_n")).alias("neg_n"), "num_value", "str_value")).alias("_m"),
        F.sum("_n").alias("count"))
    modes = modes.select(*keep, "feature", "count",
                         F.col("_m.num_value").alias("mode_num"), F.col("_m.str_value").alias("mode_str"),
                         (-F.col("_m.neg_n")).cast("long").alias("mode_n"))
    numeric = {n for n, t in df.dtypes if t.startswith(NUMERIC_TYPES)}
    num_cols = [c for c in cols if c in numeric]
    if not num_cols:
        return modes
    stats = describe(df, num_cols, by).drop("count")
    return _join_groups(modes, stats, keep + ["feature"])


def near_constant(df: DataFrame, cols: Sequence[str], share: float = 0.8) -> DataFrame:
    """Columns whose most frequent value covers at least ``share`` of the rows."""
    cf = common_features(df, cols).select("feature", "mode_num", "mode_str", "mode_n", "count")
    return (cf.withColumn("share", F.col("mode_n") / F.col("count"))
            .where(F.col("share") >= F.lit(share)))


MEASURES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_samp}


def measure_table(df: DataFrame, by: str, picks: Sequence[tuple[str, str]]) -> DataFrame:
    """Chosen (stat, column) pairs per group: (measure, group, text_value, num_value).

    ``mode`` uses the counting path of :func:`common_features`; the other
    statistics are plain aggregates in one pass.
    """
    out = []
    mode_cols = [c for s, c in picks if s == "mode"]
    if mode_cols:
        cf = common_features(df, mode_cols, by).select(
            F.concat(F.lit("mode_"), F.col("feature")).alias("measure"), by,
            F.col("mode_str").alias("text_value"), F.col("mode_num").alias("num_value"))
        out.append(cf)
    agg_picks = [(s, c) for s, c in picks if s != "mode"]
    if agg_picks:
        one = df.groupBy(by).agg(*[MEASURES[s](F.col(c).cast("double")).alias(f"{s}_{c}") for s, c in agg_picks])
        rows = [F.struct(F.lit(f"{s}_{c}").alias("measure"), F.lit(None).cast("string").alias("text_value"),
                         F.col(f"{s}_{c}").alias("num_value")) for s, c in agg_picks]
        out.append(one.select(by, _inline(rows)).select("measure", by, "text_value", "num_value"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def measure_table_wide(df: DataFrame, by: str, picks: Sequence[tuple[str, str]], groups: Sequence) -> DataFrame:
    """The measure table as stat x group: one row per measure, columns
    ``text_<g>`` / ``num_<g>`` per group (group values given, so no extra
    distinct job)."""
    long = measure_table(df, by, picks)
    wide = long.groupBy("measure").pivot(by, list(groups)).agg(F.max("text_value").alias("text"),
                                                              F.max("num_value").alias("num"))
    for g in groups:
        wide = (wide.withColumnRenamed(f"{g}_text", f"text_{g}").withColumnRenamed(f"{g}_num", f"num_{g}"))
    return wide


def centroids(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each coordinate per group."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def cumulative_share(df: DataFrame, order: str, value: str, out: str = "cumulative") -> DataFrame:
    """Running sum in ``order``. An unpartitioned window runs in one task, so
    this is meant for small summary tables (one row per component)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def call_hours(df: DataFrame, duration: str = "duration", predicted: str | None = "prediction",
               kept: str | None = None, seconds_per_hour: float = 3600.0) -> DataFrame:
    """Call time of all rows, of the kept (trimmed) rows and of the rows
    predicted positive, and the time saved between them; one row, one pass."""
    d = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
    aggs = [F.sum(d).alias("_all")]
    aggs.append(F.sum(F.when(F.col(kept), d).otherwise(0.0)).alias("_kept") if kept else F.sum(d).alias("_kept"))
    aggs.append(F.sum(F.when(F.col(predicted) == 1, d).otherwise(0.0)).alias("_pred") if predicted
                else F.sum(d).alias("_pred"))
    one = df.agg(*aggs)
    h = F.lit(float(seconds_per_hour))
    return one.select((F.col("_all") / h).alias("hours_all"), (F.col("_kept") / h).alias("hours_kept"),
                      (F.col("_pred") / h).alias("hours_predicted"),
                      ((F.col("_all") - F.col("_kept")) / h).alias("saved_by_trim"),
                      ((F.col("_all") - F.col("_pred")) / h).alias("saved_by_model"))


def tradeoff(df: DataFrame, label: str = "label", prediction: str = "prediction",
             duration: str = "duration", seconds_per_hour: float = 3600.0) -> DataFrame:
    """Positives caught (TP) and lost (all positives - TP) beside hours spent
    on the rows called (predicted positive); one row."""
    pos = F.col(label) == 1
    called = F.col(prediction) == 1
    d = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
    one = df.agg(F.sum(pos.cast("long")).alias("positives"),
                 F.sum((pos & called).cast("long")).alias("caught"),
                 F.sum(called.cast("long")).alias("called"),
                 F.sum(F.when(called, d).otherwise(0.0)).alias("_sec"))
    return one.select("positives", "caught", (F.col("positives") - F.col("caught")).alias("lost"),
                      "called", (F.col("_sec") / F.lit(float(seconds_per_hour))).alias("hours_called"))
