"""The law of the shuffle: equal rows, exact draws, large counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import sharding


def test_equal_rows_scatter(spark):
    """Two copies share one of 16 shards in a sixteenth of all cases."""
    pairs = 10_000
    df = spark.range(pairs).select(F.explode(F.array(F.col("id"), F.col("id"))).alias("doc_id"), F.lit("same text").alias("text")).repartition(7)
    got = sharding.shard(df, 16, seed=3).groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n = 1").count()
    assert abs(got - pairs / 16) < 3 * math.sqrt(pairs * 15 / 256)


def test_rows_with_maps(spark):
    df = spark.range(50).select("id", F.struct(F.create_map(F.lit("a"), "id").alias("m")).alias("s"))
    assert sharding.shard(df, 4).groupBy("shard").count().count() == 4


def law(good, bad, n):
    lo, hi = max(0, n - bad), min(good, n)
    ks = np.arange(lo, hi + 1)
    p = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in ks.tolist()])
    return ks, p


@pytest.mark.parametrize("good,bad,n", [(300, 500, 200), (300, 500, 700), (40, 9_000, 600), (900, 30, 500), (5, 7, 6)])
def test_draws_past_numpys_limit_follow_the_exact_law(monkeypatch, good, bad, n):
    monkeypatch.setattr(sharding, "MOST", 1)
    rng = np.random.default_rng(good + n)
    ks, p = law(good, bad, n)
    draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(6_000)])
    seen = np.array([(draws == k).sum() for k in ks])
    keep = p * 6_000 >= 5
    chi = ((seen[keep] - p[keep] * 6_000) ** 2 / (p[keep] * 6_000)).sum()
    df = keep.sum() - 1
    assert seen.sum() == 6_000 and chi < df + 4 * math.sqrt(2 * df) + 4


def test_large_counts_have_the_laws_mean_and_spread():
    good, bad, n = 6 * 10**10, 9 * 10**11, 4 * 10**11
    rng = np.random.default_rng(1)
    draws = np.array([sharding._draw(rng, good, bad, n) for _ in range(300)], float)
    mean, total = n * good / (good + bad), good + bad
    sd = math.sqrt(mean * bad / total * (total - n) / (total - 1))
    assert abs(draws.mean() - mean) < 4 * sd / math.sqrt(300) and 0.85 < draws.std() / sd < 1.15


def test_margins_beyond_a_billion_rows():
    counts = [3 * 10**9, 10**9 + 7, 5, 0]
    m = np.array(sharding.communication_matrix(counts, 16, 2))
    assert m.sum(1).tolist() == counts and m.sum(0).max() - m.sum(0).min() <= 1 and m.min() >= 0
