"""Missing values, constant columns, large means and wide ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.operators import dbscan as D
from callsheet.operators import explore as X
from callsheet.operators import gower as G
from callsheet.operators import metrics as M
from callsheet.operators import models as MD
from callsheet.operators import prep as P


def test_qda_with_large_means(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) + 1e9
    df = spark.createDataFrame([(float(a), float(b), int(i % 2)) for i, (a, b) in enumerate(x)], "a double, b double, label int")
    m = MD.qda(df, ["a", "b"], "label", 0.0)
    for c in (0, 1):
        want = np.linalg.eigvalsh(np.cov(x[c::2].T))
        assert np.allclose(sorted(m.scalings[c]), want, rtol=1e-4)
    assert m.transform(df).where("prediction IS NULL").count() == 0


def test_naive_bayes_with_constant_columns_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1), (None, 1)], "a double, label int")
    got = MD.gaussian_nb(df, ["a"], "label").transform(df).collect()
    assert [r.prediction for r in got] == [1, 1, 1, None]


def test_split_leaves_null_labels_out(spark):
    df = spark.range(100).withColumn("label", F.when(F.col("id") % 4 > 0, F.col("id") % 2))
    got = P.split_stratified(df, "label", "id")
    assert got.count() == 75 and got.where("label IS NULL").count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_null_group_keeps_its_quartiles(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(5)] + [("a", 1.0)], "g string, x double")
    got = {r.g: r for r in X.describe(df, ["x"], "g").collect()}
    assert (got[None].p25, got[None].p50, got[None].p75) == (1.0, 2.0, 3.0)
    assert {r.g: r.mean for r in X.common_features(df, ["x"], "g").collect()} == {None: 2.0, "a": 1.0}


def test_gower_skips_what_is_missing(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 10.0, "b"), (3, None, "b")], "id long, x double, c string")
    got = {(r.id_a, r.landmark): r.d for r in G.gower_to_landmarks(df, "id", ["x"], ["c"], 3).collect()}
    assert got[1, 1] == 0 and got[3, 3] == 0 and got[1, 2] == 1 and got[2, 3] == 0 and got[1, 3] is None


def test_dbscan_returns_rows_without_a_place(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.0), (3, None, 0.0)], "id long, x double, y double")
    assert {r.id: r.cluster for r in D.dbscan(df, "id", "x", "y", 0.3, 2).collect()} == {1: 1, 2: 1, 3: -1}


def test_dense_counts_over_a_wide_range(spark):
    df = spark.createDataFrame([(0, "a"), (12_000_000, "b")], "k long, c string")
    got = X.dense_counts(df, "k", "c")
    assert got.count() == 2 * 12_000_001 and got.agg(F.sum("n")).first()[0] == 2


def test_average_precision_is_the_step_sum(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 40, 300) / 40
    y = (rng.random(300) < s).astype(int)
    cut = np.unique(s)[::-1]
    tp = np.array([y[s >= c].sum() for c in cut])
    n = np.array([(s >= c).sum() for c in cut])
    want = float(np.sum(np.diff(np.r_[0, tp]) / y.sum() * tp / n))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, probability double")
    assert M.average_precision(df) == pytest.approx(want)
