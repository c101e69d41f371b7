"""Mergeable column summaries: quantiles and distinct counts without a rescan.

``build`` makes one row per group (say a day or a source) and column: counts,
sum, least and greatest value, a KLL sketch of the numbers and an HLL sketch of
the values, all Spark's own. Rows are stored like any table; ``merge`` adds up
those of many groups, and ``figures`` reads quantiles and distinct counts off
them, while the raw rows are not read again.

Stated errors (99 % sure): a quantile's rank is off by at most ``rank_error(k)``
of the rows, a distinct count by about ``distinct_error(lg)`` of itself. Exact
figures are those of ``explore.describe`` and ``quantiles.exact_quantiles``.
Nulls and NaN are counted as missing and are in no sketch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LG = 800, 13


def rank_error(k: int = K) -> float:
    """Published bound of the KLL sketch's rank error."""
    return 2.296 / k ** 0.9723


def distinct_error(lg: int = LG) -> float:
    """2.6 standard errors of the HLL estimate."""
    return 2.6 * 1.04 / 2 ** (lg / 2)


def build(df: DataFrame, by: Sequence[str], columns: Sequence[str], k: int = K, lg: int = LG) -> DataFrame:
    """(by..., column_name, n, missing, total, lo, hi, ranks, values)."""
    types = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = types[c] in ("string", "boolean")
        x = F.lit(None).cast("double") if text else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return F.struct(F.lit(c).alias("column_name"), x.alias("x"), (F.col(c).cast("string") if text else x.cast("string")).alias("v"))
    long = df.select(*by, F.inline(F.array(*[cell(c) for c in columns])))
    return long.groupBy(*by, "column_name").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.sum("x").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.kll_sketch_agg_double("x", k).alias("ranks"), F.hll_sketch_agg("v", lg).alias("values"))


def merge(summaries: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """Summaries of larger groups, from those of smaller ones."""
    return summaries.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("ranks", k).alias("ranks"), F.hll_union_agg("values").alias("values"))


def figures(summaries: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, n, missing, mean, lo, hi, n_distinct, quantiles):
    quantiles by ``probs`` (null for a column without numbers)."""
    at = [F.when(F.col("lo").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.lit(float(p)))) for p in probs]
    return summaries.select(*by, "column_name", "n", "missing", (F.col("total") / F.col("n")).alias("mean"), "lo", "hi",
                            F.when(F.col("n") > 0, F.hll_sketch_estimate("values")).otherwise(0).alias("n_distinct"),
                            F.when(F.col("lo").isNotNull(), F.array(*at)).alias("quantiles"))
