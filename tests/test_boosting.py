"""Boosted trees against a plain numpy version, and a stump by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.operators import boosting as B

NAMES = ["a", "b", "c", "d"]


def data(n=1000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 2, n), np.round(rng.normal(size=n), 1)], 1).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] / 4 - 1.5 + (x[:, 1] > 2) * x[:, 2] + np.sin(x[:, 3]))))).astype(int)
    x[rng.random(n) < 0.1, 3] = np.nan
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int").repartition(parts)


def plain(x, y, h, cuts, params):
    """The same rule, row by row and cut by cut."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)
    out = []

    def score(g, hh):
        return max(abs(g) - params.alpha, 0) ** 2 / (hh + params.lam)

    def weight(g, hh):
        return -params.rate * np.sign(g) * max(abs(g) - params.alpha, 0) / (hh + params.lam)

    for number in range(params.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, hs = np.rint((p - y) * B.UNIT) / B.UNIT, np.rint(p * (1 - p) * B.UNIT) / B.UNIT
        use = B.in_sample(h, params, number)

        def grow(rows, depth):
            G, H = g[rows & use].sum(), hs[rows & use].sum()
            best = None
            for f in B.tree_columns(x.shape[1], params, number) if depth else ():
                for cut in cuts[f]:
                    for left in (True, False):
                        goes = np.where(np.isnan(x[:, f]), left, x[:, f] <= cut) & rows
                        a, b = goes & use, rows & ~goes & use
                        gl, hl, gr, hr = g[a].sum(), hs[a].sum(), g[b].sum(), hs[b].sum()
                        if min(hl, hr) >= params.child_weight and min(hl, hr) > 0:
                            gain = round(score(gl, hl) + score(gr, hr) - score(G, H), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = gain, goes
            if best is None:
                return weight(G, H), None
            kids = grow(best[1], depth - 1), grow(rows & ~best[1], depth - 1)
            if best[0] < params.gamma and kids[0][1] is None and kids[1][1] is None:
                return weight(G, H), None
            return None, (best[1], kids)

        def value(tree, rows, to):
            if tree[1] is None:
                to[rows] = tree[0]
            else:
                value(tree[1][1][0], rows & tree[1][0], to)
                value(tree[1][1][1], rows & ~tree[1][0], to)
            return to
        margin = margin + value(grow(np.ones(len(y), bool), params.depth), np.ones(len(y), bool), np.zeros(len(y)))
        out.append(margin)
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("params", [B.BoostParams(rounds=3, depth=3, rate=0.3),
                                    B.BoostParams(rounds=3, depth=4, rate=0.1, subsample=0.8, colsample=0.6, gamma=2.0, alpha=0.5, lam=4.6, child_weight=3)])
def test_equals_a_plain_version_on_1000_rows(spark, params):
    x, y = data()
    df = frame(spark, x, y)
    cuts = [sorted(set(c[~np.isnan(c)]))[:-1] for c in x.T]
    model = B.boost(df, "id", NAMES, params=params, cuts=cuts)
    rows = df.withColumn("h", F.xxhash64(F.col("id"), F.lit(params.seed))).orderBy("id").collect()
    want = plain(x, y, np.array([r.h for r in rows]), cuts, params)
    got = np.array([r.probability for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-9)
    again = B.boost(frame(spark, x, y, 2), "id", NAMES, params=params, cuts=cuts)
    assert [t.feature for t in again.trees] == [t.feature for t in model.trees] and [t.value for t in again.trees] == [t.value for t in model.trees]


def test_quantile_cuts_learn_and_prune(spark):
    x, y = data(3000, 6)
    df = frame(spark, x, y)
    model = B.boost(df, "id", NAMES, params=B.BoostParams(rounds=8, depth=4))
    p = np.array([r.probability for r in model.transform(df).orderBy("id").collect()])
    assert ((p >= 0.5) == y).mean() > max(y.mean(), 1 - y.mean()) + 0.08
    assert {r.feature for r in model.importance(df.sparkSession).where("cuts > 0").collect()} >= {"a", "d"}
    bare = B.boost(df, "id", NAMES, params=B.BoostParams(rounds=1, depth=3, gamma=1e9))
    assert bare.trees[0].feature[0] == -1


def test_one_class_no_rows_and_null_labels(spark):
    x, y = data(50)
    df = frame(spark, x, np.zeros(50, int))
    p = [r.probability for r in B.boost(df, "id", NAMES, params=B.BoostParams(rounds=2)).transform(df).collect()]
    assert max(p) < 1e-6
    none = df.withColumn("label", F.lit(None).cast("int"))
    assert B.boost(none, "id", NAMES).transform(df).where("probability = 0.5").count() == 50


def test_sums_of_several_tasks_meet_in_one_shuffle(spark):
    """A bin's sums come from many tasks: the cut is that of their totals."""
    u = int(B.UNIT)
    cells = [(0, 0, 0, -4 * u, 4 * u), (0, 0, 0, -4 * u, 4 * u), (0, 0, 1, 3 * u, 4 * u), (0, 0, 1, 5 * u, 4 * u), (0, 1, 0, -8 * u, 8 * u), (0, 1, 1, 8 * u, 8 * u)]
    df = spark.createDataFrame(cells, B._CELL).repartition(3)
    got = B._best_cuts(df, np.array([2, 2]), B.BoostParams(alpha=0.0, lam=1.0))
    assert [(r.node, -r.nf, -r.nb, r.left, r.gl, r.gr) for r in got.collect()] == [(0, 0, 0, True, -8 * u, 8 * u)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_light_nodes_are_not_asked(spark, monkeypatch):
    asked = []
    real = B._histogram
    monkeypatch.setattr(B, "_histogram", lambda tree, number, open_, *rest: asked.append(len(open_)) or real(tree, number, open_, *rest))
    x, y = data(60)
    B.boost(frame(spark, x, y), "id", NAMES, "label", B.BoostParams(rounds=1, depth=8, child_weight=6.0))
    assert asked == [1]   # 60 rows weigh at most 15: both sides of a cut hold less than 12
