"""Grid search over the closed-form estimators, seeded search determinism,
stacking and k-fold invariants on small data."""

import numpy as np
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from callsheet.operators import classifiers as C
from callsheet.operators import metrics as M
from callsheet.operators import tuning as T


def _frame(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 2)) + y[:, None] * 0.8
    rows = [(i, float(a), float(b), int(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "client_id long, a double, b double, label int, fold int")


def test_grid_search_scores_every_candidate(spark):
    df = _frame(spark)
    est = C.NearestCentroidClassifier(inputCols=["a", "b"])
    grid = (ParamGridBuilder().addGrid(est.metric, ["euclidean", "manhattan"])
            .addGrid(est.shrinkThreshold, [-1.0, 0.2]).build())
    _, res = T.grid_search(est, grid, df, M.BalancedAccuracyEvaluator(), parallelism=2)
    rows = res.collect()
    assert len(rows) == 4 and all(0.0 <= r["mean_score"] <= 1.0 for r in rows)
    assert rows[0]["mean_score"] == max(r["mean_score"] for r in rows)


def test_param_search_is_seeded(spark):
    df = _frame(spark)
    tr, va = df.where(F.col("fold") != 0), df.where(F.col("fold") == 0)
    space = {"metric": T.choice("euclidean", "manhattan"), "shrinkThreshold": T.quniform(0.001, 0.5, 0.001)}

    def build(p):
        return C.NearestCentroidClassifier(inputCols=["a", "b"], metric=p["metric"],
                                           shrinkThreshold=float(p["shrinkThreshold"]))

    def score(pred):
        return M.accuracy(pred.withColumn("label", F.col("label").cast("int"))).first()[0]
    t1, b1 = T.param_search(build, space, tr, va, score, evals=4, seed=1)
    t2, b2 = T.param_search(build, space, tr, va, score, evals=4, seed=1)
    assert b1 == b2 and [r["params"] for r in t1.collect()] == [r["params"] for r in t2.collect()]
    calls = []
    T.param_search(build, space, tr, va, score, evals=3, seed=1, objective=lambda p: calls.append(p) or 0.0)
    assert len(calls) == 3


def test_cv_score_and_stacking_shapes(spark):
    df = _frame(spark)
    cv = {r["fold"]: r["accuracy"] for r in T.cv_score(C.GaussianNBClassifier(inputCols=["a", "b"]), df, 5).collect()}
    assert set(cv) == {-1, 0, 1, 2, 3, 4} and abs(cv[-1] - np.mean([cv[i] for i in range(5)])) < 1e-12
    test = _frame(spark, 60, seed=9)
    bases = {"nc": C.NearestCentroidClassifier(inputCols=["a", "b"]), "nb": C.GaussianNBClassifier(inputCols=["a", "b"])}
    out = T.stack(bases, df.withColumn("label", F.col("label").cast("double")), test, 5)
    assert out.count() == 60 and set(r[0] for r in out.select("prediction").distinct().collect()) <= {0, 1}
