"""Random-range SVD against numpy's; sketches against exact figures."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from callsheet.operators import segments as SG
from callsheet.operators import summaries as SM
from callsheet.operators import wide_svd as V


def frame(spark, x, parts=3):
    return spark.createDataFrame([(Vectors.sparse(x.shape[1], {int(j): float(r[j]) for j in np.flatnonzero(r)}),) for r in x], ["v"]).repartition(parts)


def test_singular_values_equal_the_gramian_path(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(300, 64)) * (rng.random((300, 64)) < 0.3)) * (0.85 ** np.arange(64))
    df = frame(spark, x)
    values, vectors = V.wide_svd(df, "v", 8, 64, passes=8)
    want = np.linalg.svd(x)
    assert np.allclose(values, want[1][:8], rtol=1e-6)
    assert np.allclose(np.abs((vectors * want[2][:8].T).sum(0)), 1, atol=1e-4)
    basis, _ = SG.svd_basis(df, "v", 3)
    assert np.allclose(np.abs((vectors[:, :3] * basis).sum(0)), 1, atol=1e-6)
    whole = V.wide_svd(df, "v", 64, 64, passes=1)[0]   # as many directions as features: exact
    assert np.allclose(whole, want[1], atol=1e-9 * want[1][0])
    table = V.wide_variance(df, "v", 64, 64, passes=1).collect()
    assert table[-1].cumulative == pytest.approx(1.0)


def test_a_hundred_thousand_features(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 3_000)
    rng = np.random.default_rng(1)
    p = 100_000
    rows = []
    for i in range(1_500):
        at = {int(j): 1.0 for j in rng.integers(0, p, 6)}
        at.update({(i % 3) * 7: 5.0 - i % 3, p - 1 - i % 3: 2.0})
        rows.append((Vectors.sparse(p, at),))
    values, vectors = V.wide_svd(spark.createDataFrame(rows, ["v"]).repartition(4), "v", 3, p)
    assert vectors.shape == (p, 3) and np.all(np.diff(values) < 0)
    # three groups of rows with their own two heavy features, plus six ones at random
    assert np.allclose(values ** 2, [500 * (25 + 4), 500 * (16 + 4), 500 * (9 + 4)], rtol=0.02)
    assert [int(np.abs(v).argmax()) for v in vectors.T] == [0, 7, 14]


def test_empty_rows_and_missing_vectors(spark):
    df = frame(spark, np.array([[0.0, 0.0], [0.0, 3.0]])).union(spark.createDataFrame([(None,)], "v struct<type:tinyint,size:int,indices:array<int>,values:array<double>>").select(F.lit(None).cast(frame(spark, np.eye(2)).schema["v"].dataType)))
    assert np.allclose(V.wide_svd(df, "v", 2, 2)[0], [3.0, 0.0])


def test_merged_sketches_are_within_the_stated_bounds(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=20_000), np.full(10_000, 1.0), rng.exponential(size=10_000) * 50])
    rng.shuffle(x)
    df = spark.createDataFrame([(int(i % 7), float(v), f"k{int(v * 100)}") for i, v in enumerate(x)], "day int, x double, s string")
    df = df.union(spark.createDataFrame([(0, None, None), (1, float("nan"), "z")], df.schema))
    days = SM.build(df, ["day"], ["x", "s"])
    assert days.count() == 14
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = {r.column_name: r for r in SM.figures(SM.merge(days), probs).collect()}
    for p, q in zip(probs, got["x"].quantiles):
        assert (x < q).mean() - 3 * SM.rank_error() <= p <= (x <= q).mean() + 3 * SM.rank_error()
    assert (got["x"].n, got["x"].missing, got["x"].lo, got["x"].hi) == (40_000, 2, x.min(), x.max())
    assert got["x"].mean == pytest.approx(x.mean()) and got["s"].quantiles is None
    true = df.select("s").where("s IS NOT NULL").distinct().count()
    assert abs(got["s"].n_distinct - true) <= 2 * SM.distinct_error() * true
    halves = SM.merge(SM.merge(days.withColumn("half", F.col("day") % 2), ["half"]))
    assert {r.n for r in halves.collect()} == {40_000, 40_001}


def test_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, None)], "day int, x double, s string")
    got = SM.figures(SM.merge(SM.build(df, ["day"], ["x", "s"])), [0.5]).collect()
    assert {(r.column_name, r.n, r.n_distinct, r.quantiles) for r in got} == {("x", 0, 0, None), ("s", 0, 0, None)}
    assert SM.merge(SM.build(df.where("day > 1"), ["day"], ["x"])).count() == 0
