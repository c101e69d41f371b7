"""Exact distributed quantiles vs numpy's linear interpolation, with the
narrowing passes forced by a tiny row limit."""

import numpy as np

from callsheet.operators import quantiles as Q
from callsheet.operators.quantiles import exact_quantiles


def test_exact_quantiles_narrowing_matches_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.lognormal(0, 2, 3000), np.full(1500, 7.25), rng.normal(-3, 1, 500)])
    groups = np.repeat(["a", "b"], [3500, 1500])
    rows = [(str(g), float(v)) for g, v in zip(groups, vals)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", probs, buckets=16, max_rows=20).collect()}
    for g in ("a", "b"):
        x = vals[groups == g]
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(x, p)) < 1e-9 * max(1.0, abs(np.quantile(x, p))), (g, p)


def test_exact_quantiles_single_value_and_small_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", [0.5], max_rows=1).collect()}
    assert got == {("a", 0.5): 1.0, ("b", 0.5): 2.0}


def test_ranks_of_one_interval_share_a_histogram(spark, monkeypatch):
    asked = []
    real = Q.broadcast_if_small
    monkeypatch.setattr(Q, "broadcast_if_small", lambda d: asked.append((d.columns, d.count())) or real(d))
    df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in range(500)], "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in Q.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75], buckets=16, max_rows=5).collect()}
    assert got == {(g, p): 499 * p for g in "ab" for p in (0.25, 0.5, 0.75)}
    # first pass: one interval a group, not one for each of its six ranks
    assert next(n for cols, n in asked if "_lo" in cols) == 2
