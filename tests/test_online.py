"""Mixed perceptrons against the sequential algorithm, written out again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.operators import online as L

NAMES = ["a", "b", "c"]


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, ((x @ [1.5, -2.0, 0.3] + 0.4 + rng.normal(size=n) * 0.3) > 0).astype(int)


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label int").repartition(parts)


def sequential(x, y, kind, c, epochs):
    w, b = np.zeros(3), 0.0
    for _ in range(epochs):
        for xi, t in zip(x, y * 2 - 1):
            f = w @ xi + b
            if kind == "perceptron":
                step = 1.0 if t * f <= 0 else 0.0
            elif kind == "hinge":
                step = min(c, max(0.0, 1 - t * f) / (xi @ xi))
            else:
                step = max(0.0, 1 - t * f) / (xi @ xi + 0.5 / c)
            w, b = w + step * t * xi, b + step * t
    return np.append(w, b)


@pytest.mark.parametrize("kind,loss", [("perceptron", "hinge"), ("passive_aggressive", "hinge"), ("passive_aggressive", "squared_hinge")])
def test_one_part_is_the_sequential_algorithm(spark, kind, loss):
    x, y = data()
    params = L.OnlineParams(kind=kind, loss=loss, c=0.05, epochs=3, parts=1, patience=99)
    df = frame(spark, x, y)
    order = [r.id for r in df.orderBy(F.xxhash64(F.col("id"), F.lit(params.seed)), "id").collect()]
    want = sequential(x[order], y[order], kind if kind == "perceptron" else loss, 0.05, 3)
    assert np.allclose(L.train(df, "id", NAMES, params=params).weights, want, atol=1e-9)


def test_parts_do_not_depend_on_partitions_and_learn(spark):
    x, y = data(2000)
    params = L.OnlineParams(kind="passive_aggressive", loss="squared_hinge", c=0.01, epochs=5, parts=6)
    models = [L.train(frame(spark, x, y, n), "id", NAMES, params=params) for n in (1, 5)]
    assert np.array_equal(models[0].weights, models[1].weights)
    got = models[0].transform(frame(spark, x, y)).orderBy("id").collect()
    assert np.mean([r.prediction == t for r, t in zip(got, y)]) > 0.93


def test_penalties_shrink(spark):
    x, y = data()
    df = frame(spark, x, y)
    size = {p: np.abs(L.train(df, "id", NAMES, params=L.OnlineParams(penalty=p, alpha=0.02, epochs=3, parts=2, patience=99)).weights[:-1]).sum() for p in (None, "l1", "l2")}
    assert size["l1"] < size[None] and size["l2"] < size[None]


def test_missing_features_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 1), (2, None, 1.0, 0.0, 0), (3, 0.0, 0.0, 0.0, None)], "id long, a double, b double, c double, label int")
    got = {r.id: r.prediction for r in L.train(df, "id", NAMES).transform(df).collect()}
    assert got == {1: 1, 2: None, 3: 1}
    assert not L.train(df.where("id > 9"), "id", NAMES).weights.any()


@pytest.mark.parametrize("kind", ["perceptron", "passive_aggressive"])
def test_parts_in_steps_are_the_same_training(spark, monkeypatch, kind):
    """A part of many rows is run over in steps, each a task of its own."""
    rng = np.random.default_rng(8)
    rows = [(i, *[float(v) for v in x], int(x[0] + x[1] ** 2 > 0.6)) for i, x in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(3)
    params = L.OnlineParams(kind=kind, epochs=3, parts=4)
    whole = L.train(df, "id", ["a", "b"], "label", params)
    asked = []
    real = L._epoch
    monkeypatch.setattr(L, "STEP", 20)
    monkeypatch.setattr(L, "_epoch", lambda *a: asked.append(1) or real(*a))
    stepped = L.train(df, "id", ["a", "b"], "label", params)
    assert len(asked) == 5 * stepped.epochs
    assert stepped.epochs == whole.epochs and (stepped.weights == whole.weights).all()
