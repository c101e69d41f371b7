"""DBSCAN vs brute force, Gower with L = n, GLM saturated case, SVD/k-means invariants."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from callsheet.operators import dbscan as D
from callsheet.operators import gower as G
from callsheet.operators import segments as SG
from callsheet.operators import stats as S


def brute_dbscan(pts, eps, min_pts):
    n = len(pts)
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_pts
    label = -np.ones(n, dtype=np.int64)
    comp = {}
    for i in range(n):
        if core[i] and i not in comp:
            stack, members = [i], []
            comp[i] = i
            while stack:
                j = stack.pop()
                members.append(j)
                for q in np.nonzero(nb[j] & core)[0]:
                    if q not in comp:
                        comp[q] = i
                        stack.append(q)
            lab = min(members)
            for m in members:
                label[m] = lab
    for i in range(n):
        if not core[i]:
            cand = [label[q] for q in np.nonzero(nb[i] & core)[0]]
            if cand:
                label[i] = min(cand)
    return label, core


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal([0, 0], 0.15, (80, 2)), rng.normal([2, 2], 0.3, (70, 2)),
                     rng.uniform(-1, 3, (50, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    out = {r["id"]: (r["cluster"], r["is_core"]) for r in D.dbscan(df, "id", "x", "y", 0.3, 8).collect()}
    lab, core = brute_dbscan(pts, 0.3, 8)
    assert len(out) == len(pts)
    for i in range(len(pts)):
        assert out[i][1] == bool(core[i]), i
        assert out[i][0] == lab[i], (i, out[i], lab[i])


def test_gower_full_matrix_symmetric_zero_diagonal(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, "b"), (3, 2.0, "a"), (4, 2.0, "a")],
                               "id long, x double, c string")
    d = {(r["id_a"], r["landmark"]): r["d"] for r in G.gower_to_landmarks(df, "id", ["x"], ["c"], 4).collect()}
    assert len(d) == 16
    for (a, b), v in d.items():
        assert abs(v - d[(b, a)]) < 1e-12 and (a != b or v == 0.0)
    assert abs(d[(1, 2)] - (1.0 + 1.0) / 2) < 1e-12


def test_gower_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 5.0, "b")], "id long, x double, c string")
    d = {(r["id_a"], r["landmark"]): r["d"] for r in G.gower_to_landmarks(df, "id", ["x"], ["c"], 2).collect()}
    assert d[(1, 2)] == 0.5


def test_glm_saturated_equals_log_odds(spark):
    data = [("a", 1)] * 3 + [("a", 0)] * 7 + [("b", 1)] * 6 + [("b", 0)] * 4
    df = spark.createDataFrame(data, "g string, label int")
    t = {r["term"]: r["coefficient"] for r in S.univariate_logit(df, ["g"], "label").collect()}
    lo_a, lo_b = np.log(3 / 7), np.log(6 / 4)
    assert abs(t["Intercept"] - lo_a) < 1e-8 and abs(t["g[b]"] - (lo_b - lo_a)) < 1e-8


def test_svd_variance_and_elbow_invariants(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    v = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="f").transform(df)
    sv = SG.svd_variance(v, "f", 3).collect()
    cum = [r["cumulative"] for r in sv]
    assert all(0 <= c <= 1 + 1e-9 for c in cum) and cum == sorted(cum)
    el = {r["k"]: r["inertia"] for r in SG.elbow(v, "f", 1, 3).collect()}
    assert abs(el[1] - ((x - x.mean(0)) ** 2).sum()) < 1e-6 and el[1] >= el[2] >= 0
    lab1, _ = SG.kmeans(v, "f", 3, 11)
    lab2, _ = SG.kmeans(v, "f", 3, 11)
    assert sorted(map(tuple, lab1.select("a", "cluster").collect())) == sorted(map(tuple, lab2.select("a", "cluster").collect()))


def test_dbscan_dense_cells_and_duplicates(spark):
    rng = np.random.default_rng(11)
    a = rng.normal([0, 0], 0.05, (150, 2))
    b = rng.normal([0.45, 0.0], 0.05, (150, 2))
    dup = np.repeat([[1.5, 1.5]], 40, axis=0)            # coincident points
    line = np.column_stack([np.linspace(2.0, 3.0, 30), np.full(30, 2.0)])
    pts = np.vstack([a, b, dup, line])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    for eps, mp in ((0.12, 10), (0.05, 5)):
        out = {r["id"]: (r["cluster"], r["is_core"]) for r in D.dbscan(df, "id", "x", "y", eps, mp).collect()}
        lab, core = brute_dbscan(pts, eps, mp)
        assert all(out[i] == (lab[i], bool(core[i])) for i in range(len(pts)))


def test_gower_encoded_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    x[:, 2] = 1.0                                          # constant slot
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    got = {(r["id_a"], r["landmark"]): r["d"] for r in G.gower_encoded(v, "id", "f", 30).collect()}
    rng_ = x.max(0) - x.min(0)
    inv = np.where(rng_ > 0, 1 / np.where(rng_ > 0, rng_, 1), 0.0)
    for (a, b), d in got.items():
        assert abs(d - (np.abs(x[a] - x[b]) * inv).sum() / 3) < 1e-12
    assert len(got) == 900


def test_connected_components_long_chain(spark):
    n = 200
    nodes = spark.range(0, n).withColumnRenamed("id", "node")
    e = [(i, i + 1) for i in range(n - 1) if i != 120] + [(i + 1, i) for i in range(n - 1) if i != 120]
    edges = spark.createDataFrame(e, "src long, dst long")
    lab = {r["node"]: r["label"] for r in D.connected_components(nodes, edges).collect()}
    assert all(lab[i] == (0 if i <= 120 else 121) for i in range(n))
