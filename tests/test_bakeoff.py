"""Stumps, isotonic curves and nearest neighbours against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.operators import adaptive as A
from callsheet.operators import calibration as C
from callsheet.operators import neighbours as N

NAMES = ["a", "b", "c"]


def frame(spark, x, y, parts=4):
    return spark.createDataFrame([(i, *[None if v != v else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, label int").repartition(parts)


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 10, n), rng.integers(0, 4, n), np.round(rng.normal(size=n), 1)], 1).astype(float)
    return x, (x[:, 0] + 2 * x[:, 2] + rng.normal(size=n) > 5).astype(int)


def test_stumps_equal_a_plain_version(spark):
    x, y = data()
    cuts = [sorted(set(c))[:-1] for c in x.T]
    model = A.adaptive(frame(spark, x, y), NAMES, rounds=6, cuts=cuts)
    w, votes = np.ones(len(y)) / len(y), np.zeros(len(y))
    for s in model.stumps:
        best = min((round(float(w[(np.where(x[:, f] > c, 1, 0) if up else np.where(x[:, f] > c, 0, 1)) != y].sum() / w.sum()), 12), f, c, not up)
                   for f in range(3) for c in cuts[f] for up in (True, False))
        assert (NAMES[best[1]], best[2], not best[3]) == (s.feature, s.cut, s.above)
        says = np.where((x[:, best[1]] > best[2]) == s.above, 1, -1)
        assert s.vote == pytest.approx(np.log((1 - best[0]) / best[0]), abs=1e-9)
        w = w * np.where(says * (2 * y - 1) < 0, np.exp(s.vote), 1)
        votes += s.vote * says
    got = np.array([r.prediction for r in model.transform(frame(spark, x, y)).orderBy("id").collect()])
    assert len(model.stumps) == 6 and np.array_equal(got, (votes > 0).astype(int)) and (got == y).mean() > 0.85


def test_a_perfect_stump_decides_and_one_class_has_none(spark):
    x, y = data()
    sure = A.adaptive(frame(spark, x, (x[:, 0] > 4).astype(int)), NAMES, cuts=[[1.0, 4.0], [1.0], [0.0]])
    assert [(s.feature, s.cut, s.above) for s in sure.stumps] == [("a", 4.0, True)]
    assert A.adaptive(frame(spark, x[:5], y[:5]).where("id > 9"), NAMES, cuts=[[1.0], [], []]).stumps == []
    holes = frame(spark, [[float("nan"), 1, 1]], [1])
    assert sure.transform(holes).first().prediction is None


def plain_isotonic(s, y):
    values = np.unique(s)
    n = np.array([(s == v).sum() for v in values])
    p = np.array([y[s == v].sum() for v in values])
    cn, cp = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(p)]
    m = len(values)
    fit = [max(min((cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) for b in range(i, m)) for a in range(i + 1)) for i in range(m)]
    return dict(zip(values.tolist(), fit))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_isotonic_equals_the_max_min_formula(spark, parts):
    rng = np.random.default_rng(parts)
    s = np.round(rng.normal(size=700), 1)
    y = (rng.random(700) < 1 / (1 + np.exp(-2 * s))).astype(int)
    want = plain_isotonic(s, y)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, label int").repartition(5)
    curve = C.isotonic(df, "s", parts=parts)
    values = sorted(want)
    assert np.allclose(curve(np.array(values)), [want[v] for v in values])
    assert np.all(np.diff(curve.value) > 0) and curve.table(df.sparkSession).count() == len(curve.value)
    out = curve.transform(df.union(spark.createDataFrame([(None, 1)], df.schema)), "s")
    assert out.where("s IS NULL AND calibrated IS NULL").count() == 1
    assert C.isotonic(df.where("s > 99"), "s").transform(df, "s").where("calibrated IS NULL").count() == 700


def test_cross_fitted_is_the_mean_of_the_folds(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=900)
    y = (rng.random(900) < 1 / (1 + np.exp(-3 * s))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b), i % 3) for i, (a, b) in enumerate(zip(s, y))], "id long, x double, label int, fold int")
    got = C.cross_fitted(df, df, lambda rows: lambda d: d.withColumn("raw", F.col("x") * 2), "raw", folds=3).orderBy("id").collect()
    curves = [plain_isotonic(2 * s[np.arange(900) % 3 == k], y[np.arange(900) % 3 == k]) for k in range(3)]
    want = np.mean([np.interp(2 * s, sorted(c), [c[v] for v in sorted(c)]) for c in curves], axis=0)
    assert np.allclose([r.probability for r in got], want)


@pytest.mark.parametrize("cell,block", [(5_000, 5_000), (40, 25)])
def test_neighbours_equal_all_distances(spark, monkeypatch, cell, block):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "BLOCK", block)
    x, y = data(500, 3)
    x[:150] = [3, 1, 0.5]      # a third of all rows are equal
    q = np.concatenate([data(120, 4)[0], [[3, 1, 0.5]] * 30, [[99, 99, 99]]])
    train, asked = frame(spark, x, y), frame(spark, q, np.zeros(len(q)))
    got = {}
    for r in N.nearest(train, asked, "id", NAMES, 7).collect():
        got.setdefault(r.id, []).append((r.d2, r.neighbour))
    for i, v in enumerate(q):
        d2 = (v[0] - x[:, 0]) ** 2 + (v[1] - x[:, 1]) ** 2 + (v[2] - x[:, 2]) ** 2
        assert sorted(got[i]) == sorted(zip(d2.tolist(), range(len(x))))[:7]
    near = {r.id: r.prediction for r in N.classify(train, asked, "id", NAMES, k=7).collect()}
    assert all(near[i] == int(2 * sum(y[j] for _, j in got[i]) > 7) for i in range(len(q)))


def test_fewer_rows_than_neighbours_and_missing_features(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1), (2, 1.0, 0.0, 0.0, 1), (3, None, 0.0, 0.0, 0)], "id long, a double, b double, c double, label int")
    assert {r.id: r.prediction for r in N.classify(df, df, "id", NAMES).collect()} == {1: 1, 2: 1, 3: None}
    assert {r.prediction for r in N.classify(df.where("id > 9"), df, "id", NAMES).collect()} == {None}
