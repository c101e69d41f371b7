"""What large tables and full parameters need: each failed before its mend."""

import numpy as np
from pyspark.sql import functions as F

from callsheet.functions.columns import seeded_hash
from callsheet.operators import boosting as B
from callsheet.operators import classifiers as C
from callsheet.operators import metric_dbscan as MDB
from callsheet.operators import models as MD
from callsheet.operators import neighbours as N
from callsheet.plans import ml_queries as Q
SMALL = "/root/testdata/sf0.001"


def test_bakeoff_members_do_their_whole_work(spark):
    """QDA has its covariances, though the levels of a column add up to one."""
    rng = np.random.default_rng(3)
    n = 400
    y, level = rng.integers(0, 2, n), rng.integers(0, 3, n)
    x = rng.normal(size=n) * (1 + y) + level
    rows = [(float(a), *[float(k == v) for v in range(3)], int(c)) for a, k, c in zip(x, level, y)]
    df = spark.createDataFrame(rows, "a double, l0 double, l1 double, l2 double, label int")
    names = ["a", "l0", "l1", "l2"]
    line_up = C.bakeoff(names)
    assert line_up["GBT"].getMaxIter() == 100 and line_up["LinearSVC"].getMaxIter() == 1000
    model = line_up["QDA"].fit(df)
    got = np.array([r.probability[1] for r in model.transform(df).collect()])
    f = np.array(rows)[:, :3]   # without the last level the covariances have full rank
    scores = []
    for c in (0, 1):
        d, cov = f - f[y == c].mean(0), np.cov(f[y == c].T)
        scores.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    want = 1 / (1 + np.exp(scores[0] - scores[1]))
    assert not np.allclose(model.fitted.scalings[0], 1.0) and np.allclose(got, want, atol=1e-6)
    assert 0.55 < (np.array([r.prediction for r in MD.qda(df, names, "label").transform(df).collect()]) == y).mean()


def test_prepared_keeps_only_plain_columns(spark):
    """Vectors and 0/1 columns are ten times as wide as the columns they are made of."""
    train, _, _ = Q.prepared(spark, SMALL)
    leaves = train._jdf.queryExecution().withCachedData().collectLeaves()
    kept = {leaves.apply(i).output().apply(j).name() for i in range(leaves.size()) for j in range(leaves.apply(i).output().size())}
    assert {"client_id", "balance", "job", "fold"} <= kept
    assert not {"features", "job_is_0", "_num"} & kept


def test_a_sample_is_cut_before_it_reaches_the_driver(spark):
    df = spark.range(30_000).select("id", (F.col("id") * 2).alias("x")).repartition(40)
    plain = df.withColumn("_h", seeded_hash("id", N.SEED)).orderBy("_h", "id").limit(500).select("x").collect()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    for rows, n in ((df, 30_000), (df, 600)):   # a count that is too small costs rounds, not rows
        assert N.hashed_sample(rows, "id", n, 500, ["x"]) == plain
    sc.setJobGroup("sample", "")
    N.hashed_sample(df, "id", 30_000, 500, ["x"])
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(max(tracker.getJobInfo(j).stageIds)) for j in tracker.getJobIdsForGroup("sample")]
    assert min(s.numTasks for s in stages) == 1 and all(s.numTasks == 1 for s in stages if s.stageId == max(x.stageId for x in stages))
    holes = df.withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id")))   # null ids come first
    assert len(N.hashed_sample(holes, "id", 30_000, 500, ["id"])) == 500


def test_a_level_is_a_bounded_number_of_sums(spark, monkeypatch):
    """However many tasks hold the rows, few hand on sums; the trees are the same."""
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b > 0), int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)).round(2).tolist())]
    seen, best = [], B._best_cuts
    monkeypatch.setattr(B, "_best_cuts", lambda cells, *a: seen.append(cells.rdd.getNumPartitions()) or best(cells, *a))
    monkeypatch.setattr(B, "_tasks", lambda state: 3, raising=False)
    trees = []
    for parts in (1, 40):
        df = spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(parts)
        trees.append(B.boost(df, "id", ["a", "b"], "label", B.BoostParams(rounds=1, depth=3), [[-1.0, 0.0, 1.0], [0.0]]).trees[0])
    assert max(seen) == 3 and trees[0] == trees[1]


def test_pairs_of_balls_hold_no_vectors(spark):
    rows = [(i, [float(i), 0.0], 0.0) for i in range(4)]
    got = MDB._ball_pairs(spark.createDataFrame(rows, "ball long, bv array<double>, r double"), 1.0)
    assert not any("array" in kind for _, kind in got.dtypes)
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a in range(4) for b in range(4) if abs(a - b) <= 1}
