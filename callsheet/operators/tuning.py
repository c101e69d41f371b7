"""Tuning and ensembles: cross-validated grid search, seeded parameter
search, k-fold score and stacking.

Folds come from :func:`callsheet.operators.prep.stratified_folds`, an exact
per-class round-robin over a seeded hash, passed to ``CrossValidator`` as
``foldCol`` so every candidate sees the same folds. Each trial is an
ordinary distributed fit; only parameters and scores live on the driver.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.operators.metrics import BalancedAccuracyEvaluator

SEED = 6932


def grid_search(est: Estimator, grid: list, data: DataFrame, evaluator: Evaluator | None = None,
                fold_col: str = "fold", parallelism: int = 4, k: int = 5):
    """Cartesian grid x folds; returns (fitted CrossValidatorModel, results
    frame (candidate, params, mean_score, std_score) sorted best first)."""
    evaluator = evaluator or BalancedAccuracyEvaluator()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=evaluator, foldCol=fold_col, numFolds=k,
                        parallelism=parallelism, seed=SEED)
    model = cv.fit(data)
    rows = []
    for i, (pm, m, s) in enumerate(zip(grid, model.avgMetrics, model.stdMetrics)):
        params = {p.name: str(v) for p, v in pm.items()}
        rows.append((i, params, float(m), float(s)))
    res = data.sparkSession.createDataFrame(rows, "candidate int, params map<string,string>, mean_score double, "
                                                  "std_score double")
    asc = not evaluator.isLargerBetter()
    return model, res.orderBy(F.col("mean_score").asc() if asc else F.col("mean_score").desc(), "candidate")


def fold_scores(data: DataFrame, fit_all: Callable[[DataFrame], list], fold_col: str = "fold", label: str = "label",
                k: int = 5, only: Sequence[int] | None = None) -> DataFrame:
    """(fold, candidate, tp, fn, tn, fp) of closed-form candidates.

    ``fit_all(train)`` returns one fitted model per candidate; candidates share
    their aggregates, so a fold costs the fits' few scans, one scan scores all
    candidates as columns, and one grouped aggregate counts them. ``only``
    limits the held-out folds.
    """
    def count(y: int, p: int):
        return F.sum(((F.col("y") == y) & (F.col("p") == p)).cast("long"))

    found = []
    for i in range(k) if only is None else only:
        models = fit_all(data.where(F.col(fold_col) != i))
        held = data.where(F.col(fold_col) == i)
        for at in range(0, len(models), AT_ONCE):   # a plan holds the coefficients of so many candidates
            rows = F.array(*[F.struct(F.lit(c).alias("candidate"), m.predicted().alias("p"))
                             for c, m in enumerate(models[at:at + AT_ONCE], at)])
            got = held.select(F.col(label).cast("int").alias("y"), F.inline(rows)).groupBy("candidate").agg(
                count(1, 1).alias("tp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"), count(0, 1).alias("fp"))
            found += [(i, *r) for r in got.collect()]   # four counts a candidate
    return data.sparkSession.createDataFrame(found, "fold int, candidate int, tp long, fn long, tn long, fp long")


AT_ONCE = 10


# ----------------------------------------------------------- seeded search

def choice(*options):
    return ("choice", list(options))


def quniform(low: float, high: float, q: float):
    return ("quniform", (low, high, q))


def _draw(space: Mapping, rng: random.Random) -> dict:
    out = {}
    for k, (kind, arg) in space.items():
        if kind == "choice":
            out[k] = rng.choice(arg)
        else:
            lo, hi, q = arg
            v = round(rng.uniform(lo, hi) / q) * q
            out[k] = int(v) if float(q).is_integer() and float(lo).is_integer() else v
    return out


def param_search(build: Callable[[dict], Estimator], space: Mapping, train: DataFrame, valid: DataFrame,
                 score: Callable[[DataFrame], float], evals: int = 50, seed: int = SEED,
                 objective: Callable | None = None, clock: bool = False):
    """Seeded random search of a mixed choice / quantised-uniform space.

    Each trial: ``build(params)`` -> fit on ``train`` -> ``score`` on the
    predictions of ``valid``; the loss is ``-score`` unless a replacement
    ``objective(params) -> loss`` is given. Returns (trials frame, best params).
    """
    rng = random.Random(seed)

    def default_objective(params):
        model = build(params).fit(train)
        return -float(score(model.transform(valid)))

    obj = objective or default_objective
    rows, best, best_loss = [], None, None
    for t in range(evals):
        params = _draw(space, rng)
        t0 = time.time()
        loss = obj(params)
        rows.append((t, {k: str(v) for k, v in params.items()}, -loss, time.time() - t0))
        if best_loss is None or loss < best_loss:
            best, best_loss = params, loss
    trials = train.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, score double, "
                                                      "seconds double")
    return trials if clock else trials.drop("seconds"), best


def draws(space: Mapping, evals: int = 50, seed: int = SEED) -> list[dict]:
    """The points that ``param_search`` tries."""
    rng = random.Random(seed)
    return [_draw(space, rng) for _ in range(evals)]


# ------------------------------------------------------ k-fold and stacking

def cv_predictions(est: Estimator, data: DataFrame, k: int = 5, fold_col: str = "fold",
                   keep: Sequence[str] = ("client_id", "label")) -> DataFrame:
    """Out-of-fold predictions: fold i is predicted by a model fitted on the
    other folds; the k prediction frames are unioned (no join)."""
    parts = []
    for i in range(k):
        model = est.fit(data.where(F.col(fold_col) != i))
        parts.append(model.transform(data.where(F.col(fold_col) == i))
                     .select(*keep, F.lit(i).alias(fold_col), F.col("prediction").cast("int").alias("prediction")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_score(est: Estimator, data: DataFrame, k: int = 5, fold_col: str = "fold", label: str = "label") -> DataFrame:
    """Per-fold accuracy and the mean, from one grouped aggregate."""
    oof = cv_predictions(est, data, k, fold_col, (label,))
    per = oof.groupBy(fold_col).agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))
    return per.unionByName(per.agg(F.lit(-1).alias(fold_col), F.avg("accuracy").alias("accuracy")))


def stack(bases: Mapping[str, Estimator], train: DataFrame, test: DataFrame, k: int = 5, fold_col: str = "fold",
          label: str = "label", id_col: str = "client_id", meta: Estimator | None = None) -> DataFrame:
    """Stacking: out-of-fold base predictions train a logistic meta-model;
    bases refitted on all of train feed it on test. A base hands on its
    probability of class 1 if it has one, else its prediction. Each fold
    carries all bases as columns, so folds are unioned, never joined."""
    meta = meta or LogisticRegression(featuresCol="_meta_x", labelCol=label, maxIter=100)
    names = list(bases)

    def add(model, name: str, frame: DataFrame) -> DataFrame:
        got = model.transform(frame)
        if "probability" not in got.columns:
            return got.withColumn(f"p_{name}", F.col("prediction").cast("double")).drop("prediction")
        p = F.col("probability") if got.schema["probability"].dataType.typeName() == "array" else vector_to_array("probability")
        return got.withColumn(f"p_{name}", p[1]).drop("prediction", "probability", "rawPrediction")

    folds = []
    for i in range(k):
        tr, ho = train.where(F.col(fold_col) != i), train.where(F.col(fold_col) == i)
        cur = ho
        for n in names:
            cur = add(bases[n].fit(tr), n, cur)
        folds.append(cur.select(id_col, label, *[F.col(f"p_{n}").cast("double") for n in names]))
    oof = folds[0]
    for f_ in folds[1:]:
        oof = oof.unionByName(f_)
    asm = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="_meta_x")
    meta_model = meta.fit(asm.transform(oof.withColumn(label, F.col(label).cast("double"))))
    cur = test
    for n in names:
        cur = add(bases[n].fit(train), n, cur)
    scored = meta_model.transform(asm.transform(cur.select(id_col, label, *[F.col(f"p_{n}").cast("double")
                                                                          for n in names])))
    return scored.select(id_col, label, *[f"p_{n}" for n in names], F.col("prediction").cast("int").alias("prediction"))
