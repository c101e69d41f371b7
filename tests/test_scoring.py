"""Closed-form scores: each computed once, in time linear in the features; the registry without the optional folders."""

import os
import shutil
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.functions.columns import Levels
from callsheet.operators import models as MD
from callsheet.plans import model_queries as Q
from tests.conftest import ROOT, SMALL


def loops(df) -> int:
    """Score loops in the optimised plan above what is cached."""
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0].count("aggregate(")


def frame(spark, p, n=40_000):
    cols = [F.rand(j).alias(f"x{j}") for j in range(p)]
    return spark.range(0, n, 1, 4).select("id", (F.col("id") % 2).cast("int").alias("label"), *cols), [f"x{j}" for j in range(p)]


@pytest.mark.parametrize("fit", [MD.gaussian_nb, MD.nearest_centroid, lambda *a: MD.qda(*a, reg_param=1.0)])
def test_each_score_once_and_linear(spark, fit):
    took = {}
    for p in (13, 52):
        df, xs = frame(spark, p)
        df = df.cache()
        out = fit(df, xs, "label").transform(df)
        assert loops(out) == 2  # one per class
        runs = []
        for _ in range(3):
            t = time.time()
            out.agg(F.sum("prediction")).collect()
            runs.append(time.time() - t)
        took[p] = min(runs)
        df.unpersist()
    assert took[52] < 4 * 2.5 * max(took[13], 0.1)


def test_trim_holds_one_loop_a_class(spark):
    assert loops(Q.trimmed(spark, SMALL)) == 2


def test_rotated_scores_equal_the_density(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, label int")
    m = MD.qda(df, ["a", "b", "c"], "label", 0.2)
    got = np.array([r.probability for r in m.transform(df).collect()])
    want = []
    for c in (0, 1):
        w, u = np.linalg.eigh(np.cov(x[y == c].T))
        w = 0.8 * w + 0.2
        z = (x - x[y == c].mean(0)) @ u
        want.append(np.log((y == c).mean()) - 0.5 * np.log(w).sum() - 0.5 * (z ** 2 / w).sum(1))
    want = np.exp(np.array(want).T - np.max(want, axis=0)[:, None])
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-9)


def test_medians_of_indicators_follow_from_counts(spark):
    rows = [(0, 1.0, 5.0), (0, 0.0, 1.0), (0, 0.0, 2.0), (1, 1.0, 0.0), (1, 0.0, 1.0), (1, 1.0, 9.0), (1, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "label int, f double, x double")
    m = MD.nearest_centroid(df, ["f", "x"], "label", metric="manhattan")
    assert m.centroids == {0: [0.0, 2.0], 1: [0.5, 0.75]}


def test_registry_without_the_text_operators(tmp_path):
    for name in ("callsheet", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = ("import __spark_entry__ as e; from callsheet.session import get_session\n"
            "q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1') for k in q)\n"
            "assert set(e.oracle_sql()) <= set(q)\n"
            f"print(q['segment_rate'](get_session('local[2]', 2), {SMALL!r}).count())")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0, got.stderr[-2000:]
    # a left-over folder without sources, and a pipeline file without its operators
    (tmp_path / "callsheet" / "llm" / "__pycache__").mkdir(parents=True)
    (tmp_path / "corpus_pipeline.py").write_text("from callsheet.llm import frames\n")
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'pipeline' not in e.queries()"], cwd=tmp_path,
                         capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0, got.stderr[-2000:]


@pytest.mark.parametrize("fit", [MD.gaussian_nb, MD.nearest_centroid, lambda *a: MD.nearest_centroid(*a, metric="manhattan")])
def test_levels_are_their_indicator_columns(spark, fit):
    rng = np.random.default_rng(8)
    kinds, sizes = ["a", "b", "c", "other", None], ["s", "l"]
    rows = [(float(v) if v > -1.5 else None, kinds[int(k)], sizes[int(z)], int(v + k > 2 + n))
            for v, k, z, n in zip(rng.normal(1, 2, 400), rng.integers(0, 5, 400), rng.integers(0, 2, 400), rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, "x double, kind string, size string, label int")
    levels = [Levels("kind", ("a", "b", "c")), Levels("size", ("s", "m"))]
    plain = [(f"{g.column}_{v}", F.when(F.col(g.column) == v, 1.0).otherwise(0.0)) for g in levels for v in g.levels]
    wide = df.select("*", *[c.alias(n) for n, c in plain])
    named = fit(wide, [plain[0][0], plain[1][0], plain[2][0], "x", plain[3][0], plain[4][0]], "label")
    short = fit(df, [levels[0], "x", levels[1]], "label")
    for k in ("means", "variances", "centroids"):
        for c in getattr(named, k, {}):
            assert getattr(short, k)[c] == pytest.approx(getattr(named, k)[c], rel=1e-9, abs=1e-12)
    cols = ["prediction"] + (["probability"] if hasattr(named, "log_prior") else [])
    got, want = (m.transform(wide).select(*cols).collect() for m in (short, named))
    assert [r.prediction for r in got] == [r.prediction for r in want] and None in [r.prediction for r in got]
    if len(cols) > 1:
        assert [r.probability for r in got if r.probability] == [pytest.approx(r.probability, abs=1e-9) for r in want if r.probability]
    only = fit(df, levels, "label").transform(df).where("prediction is null").count()
    assert only == 0


def test_two_layers_do_not_write_levels_out(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = Q.two_layer(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (job" not in plan and "aggregate(" in plan
