"""The learning search on a known surface; named collinear and separating terms."""

import math
import statistics

import numpy as np
import pytest

from callsheet.operators import regression_checks as R
from callsheet.operators import search as S
from callsheet.operators import tuning as T

SPACE = {"x": T.quniform(0.0, 1.0, 0.001), "z": T.quniform(1, 300, 1), "c": T.choice("a", "b", "d", "e")}


def surface(points, fold):
    return [-(p["x"] - 0.37) ** 2 * 4 - ((p["z"] - 220) / 300) ** 2 - (p["c"] != "b") * 0.5 for p in points]


def test_better_than_random_draws_in_50_trials():
    learned = [S.Search(SPACE, surface, seed=s).run().score for s in range(12)]
    drawn = [max(surface(T.draws(SPACE, 50, s), 0)) for s in range(12)]
    assert statistics.mean(learned) > statistics.mean(drawn) and statistics.median(learned) > 3 / 4 * statistics.median(drawn)
    again = S.Search(SPACE, surface, seed=3)
    assert again.run().score == learned[3] and len(again.trials) == 50 and all(isinstance(t.params["z"], int) for t in again.trials)


def test_folds_stop_poor_trials_and_the_objective_may_be_replaced(spark):
    calls = []
    search = S.Search(SPACE, lambda points, fold: [0.0] * len(points), folds=4, evals=30)
    search.set_objective(lambda points, fold: (calls.append((len(points), fold)), surface(points, fold))[1])
    best = search.run()
    assert not best.stopped and len(best.folds) == 4
    stopped = [t for t in search.trials if t.stopped]
    assert stopped and all(len(t.folds) < 4 for t in stopped) and sum(n for n, _ in calls) < 4 * 30
    rows = search.table(spark).collect()
    assert len(rows) == 30 and max(r.score for r in rows if not r.stopped) == best.score


def test_a_small_space_is_used_up():
    search = S.Search({"c": T.choice(1, 2, 3)}, lambda points, fold: [float(p["c"]) for p in points], evals=50, batch=2)
    assert search.run().params == {"c": 3} and len(search.trials) == 3


def table(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.normal())
        rows.append((a, b, 2 * a - 3 * b + 1, 5.0, "uv"[i % 2], int(rng.random() < 1 / (1 + math.exp(-a)))))
    return spark.createDataFrame(rows, "a double, b double, s double, k double, g string, y int")


def test_collinear_terms_are_named_and_the_rest_is_fitted(spark):
    df = table(spark)
    found = {r.term: (r.issue, r.detail) for r in R.formula_checks(df, "y ~ a + b + s + k + g").collect()}
    assert found == {"s": ("collinear", "a, b"), "k": ("constant", "")}
    got = {r.term: r for r in R.checked_logit(df, "y ~ a + b + s + k + g").collect()}
    assert math.isnan(got["s"].coefficient) and got["s"].note == "collinear: a, b" and got["k"].note == "constant"
    from callsheet.operators import stats
    want = {r.term: r.coefficient for r in stats.formula_logit(df, "y ~ a + b + g").collect()}
    assert all(got[t].coefficient == pytest.approx(c, abs=1e-6) and got[t].note is None for t, c in want.items())
    ols = {r.term: r for r in R.checked_ols(df, "b ~ a + s + g").collect()}
    assert all(r.note is None for r in ols.values()) and ols["a"].coefficient == pytest.approx(2 / 3)


def test_separation_alone_and_together(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), float(u), "t" if v > 0 else "f", int(v > 0)) for v, u in rng.normal(size=(120, 2))]
    df = spark.createDataFrame(rows, "v double, u double, g string, y int")
    got = {r.term: r for r in R.checked_logit(df, "y ~ v + u").collect()}
    assert got["v"].coefficient == math.inf and got["v"].note == "separates: label 1 above" and abs(got["u"].coefficient) < 5
    assert [r.issue for r in R.formula_checks(df, "y ~ g").collect()] == ["separates"]
    both = spark.createDataFrame([(float(v), float(u), int(v + 2 * u > 0)) for v, u in rng.normal(size=(200, 2))], "v double, u double, y int")
    assert [(r.term, r.issue) for r in R.formula_checks(both, "y ~ v + u").collect()] == [("", "separated")]
    assert all(r.note == "separated: by all terms together" for r in R.checked_logit(both, "y ~ v + u").collect())
    noisy = both.union(spark.createDataFrame([(3.0, 3.0, 0), (-3.0, -3.0, 1)], both.schema))
    assert R.formula_checks(noisy, "y ~ v + u").count() == 0


def test_one_class_and_no_rows(spark):
    df = table(spark, 20)
    assert R.formula_checks(df.where("y = 1"), "y ~ a + b").count() == 0
