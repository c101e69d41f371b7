"""Split exactness, encoding edge cases, closed-form models and metrics."""

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from callsheet.functions.columns import seeded_hash
from callsheet.operators import metrics as M
from callsheet.operators import models as MD
from callsheet.operators import prep as P


def test_rank_matches_plain_window(spark):
    df = spark.range(0, 3000).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    fast = P.rank_within_class(df, "label", "id", 6932, bucket_digits=2)
    w = Window.partitionBy("label").orderBy(seeded_hash("id", 6932), "id")
    plain = df.withColumn("r", F.row_number().over(w))
    j = fast.join(plain, ["id", "label"])
    assert j.where(F.col("_rank") != F.col("r")).count() == 0


def test_split_is_exact_per_class(spark):
    df = spark.range(0, 1001).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    s = P.split_stratified(df, "label", "id", 0.5)
    got = {(r["label"], r["is_train"]): r["count"] for r in s.groupBy("label", "is_train").count().collect()}
    n1, n0 = 334, 667
    assert got[(1, True)] == round(n1 * 0.5 + 1e-9) and got[(0, True)] == math.floor(n0 * 0.5 + 0.5)
    folds = P.stratified_folds(df, "label", "id", 5).groupBy("fold").count().collect()
    sizes = sorted(r["count"] for r in folds)
    assert sizes[-1] - sizes[0] <= 2


def test_one_hot_unseen_and_null_are_all_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "job string")
    test = spark.createDataFrame([("a",), ("c",), (None,)], "job string")
    out = P.one_hot(train, ["job"], test).select("job", vector_to_array("job_oh").alias("v")).collect()
    v = {r["job"]: r["v"] for r in out}
    assert v["a"] == [1.0, 0.0] and v["c"] == [0.0, 0.0] and v[None] == [0.0, 0.0]


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, x double")
    out = P.standardize(df, ["c", "x"]).collect()
    assert [r["c"] for r in out] == [0.0, 0.0] and sorted(r["x"] for r in out) == [-1.0, 1.0]


def test_gaussian_nb_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) + np.repeat([[0, 0], [1.5, 0.5]], 100, axis=0)
    y = np.repeat([0, 1], 100)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    m = MD.gaussian_nb(df, ["a", "b"], "label")
    got = np.array([r["probability"][0] for r in m.transform(df).select("probability").collect()])
    eps = 1e-9 * x.var(axis=0).max()
    jll = []
    for c in (0, 1):
        xc = x[y == c]
        mu, var = xc.mean(axis=0), xc.var(axis=0) + eps
        jll.append(np.log(0.5) - 0.5 * np.log(2 * np.pi * var).sum() - 0.5 * (((x - mu) ** 2) / var).sum(axis=1))
    jll = np.array(jll).T
    p0 = np.exp(jll[:, 0] - jll.max(axis=1)) / np.exp(jll - jll.max(axis=1, keepdims=True)).sum(axis=1)
    assert np.allclose(got, p0, atol=1e-9)


def test_shrunken_centroid_matches_formula(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) + np.repeat([[0, 0, 0], [2, 0, 1]], 30, axis=0)
    y = np.repeat([0, 1], 30)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, d double, label int")
    m = MD.nearest_centroid(df, ["a", "b", "d"], "label", shrink_threshold=0.5)
    n, k = len(x), 2
    overall = x.mean(axis=0)
    cents = np.array([x[y == c].mean(axis=0) for c in (0, 1)])
    within = sum(((x[y == c] - cents[c]) ** 2).sum(axis=0) for c in (0, 1))
    s = np.sqrt(within / (n - k))
    s = s + np.median(s)
    for c in (0, 1):
        mk = np.sqrt(1 / 30 - 1 / n)
        d = (cents[c] - overall) / (mk * s)
        d = np.sign(d) * np.clip(np.abs(d) - 0.5, 0, None)
        assert np.allclose(m.centroids[c], overall + mk * s * d)


def test_qda_reg_one_is_identity(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (1.0, 0.5, 0), (3.0, 2.0, 1), (4.0, 3.0, 1)], "a double, b double, label int")
    m = MD.qda(df, ["a", "b"], "label", 1.0)
    for c in (0, 1):
        assert np.allclose(m.scalings[c], 1.0)


def test_probability_exactly_trim_level_is_dropped(spark):
    df = spark.createDataFrame([(0.99,), (0.9899,)], "p0 double")
    assert df.where(F.col("p0") < 0.99).count() == 1


def test_confusion_ratios_zero_denominator(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 1)], "model string, label int, prediction int")
    r = M.confusion_ratios(df).first()
    assert r["tp"] == 0.0 and r["fn"] == 0.0 and r["tn"] == 0.5 and r["fp"] == 0.5


def test_report_invariants(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (0, 0)], "label int, prediction int")
    rep = {r["row"]: r for r in M.classification_report(df).collect()}
    assert rep["accuracy"]["f1"] == 0.8 and rep["macro avg"]["support"] == 5
    bal = M.balanced_accuracy(df).first()[0]
    assert abs(bal - (2 / 3 + 1.0) / 2) < 1e-12


def test_vote_majority(spark):
    df = spark.createDataFrame([(1, 1, 0), (0, 0, 1), (1, 1, 1)], "a int, b int, c int")
    assert [r["prediction"] for r in MD.vote(df, ["a", "b", "c"]).collect()] == [1, 0, 1]


def test_rank_parts_matches_window_cuts(spark):
    df = spark.range(0, 2000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    cuts = lambda n: [n // 4, n // 2, (3 * n) // 4]
    got = P.rank_parts(df, "label", "id", cuts, 6932, "part", bucket_digits=1)
    w = Window.partitionBy("label").orderBy(seeded_hash("id", 6932), "id")
    ref = df.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    ref = ref.withColumn("want", (F.col("r") > F.floor(F.col("n") / 4)).cast("int")
                         + (F.col("r") > F.floor(F.col("n") / 2)).cast("int")
                         + (F.col("r") > F.floor(F.col("n") * 3 / 4)).cast("int"))
    j = got.join(ref, ["id", "label"])
    assert j.count() == 2000 and j.where(F.col("part") != F.col("want")).count() == 0


def test_rank_cuts_do_not_move_the_rows(spark):
    df = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 2).cast("int").alias("label"))
    seen = []
    real = P.F.broadcast
    try:
        P.F.broadcast = lambda d: seen.append(d.columns) or real(d)
        got = P.split_stratified(df, "label", "id", 0.5).groupBy("label", "is_train").count().collect()
    finally:
        P.F.broadcast = real
    assert any("_t" in c for c in seen) and sorted(r["count"] for r in got) == [5000] * 4
