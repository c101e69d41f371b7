"""Spark ML model, significance-table and tuning queries.

Iterative or seeded fits are checked by row counts and unit-test
invariants; where a closed form exists (saturated logit = log-odds, one
regressor OLS = regr_slope / regr_intercept) an SQL twin checks values.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.columns import yes_no
from callsheet.operators import classifiers as C
from callsheet.operators import metrics as M
from callsheet.operators import models as MD
from callsheet.operators import prep as P
from callsheet.operators import regression_checks as RC
from callsheet.operators import stats as S
from callsheet.operators import tuning as T
from callsheet.operators.search import Search
from callsheet.plans.model_queries import BASE, L2_FEATURES, SEED, _gnb_cte, labeled
from callsheet.plans.registry import query
from callsheet.session import materialize, persist, spread
from callsheet.sources.clients import CATEGORICAL, NUMERIC, clients, indicators_sql, with_indicators

ALL = CATEGORICAL + NUMERIC


def prepared(spark, sf_dir):
    """Train/test frames with the encoded ``features`` vector, the z-scored
    numeric columns for the closed forms and 5 stratified folds on train.
    Only the plain columns are kept, some 100 bytes a row: vectors and 0/1
    columns, ten times that, are written out where a fit asks for them."""
    n = clients(spark, sf_dir, ["client_id"]).count()
    c = persist(spread(clients(spark, sf_dir), "client_id", n).withColumn("label", yes_no("y")))
    lab = materialize(P.split_and_folds(c, "label", "client_id", 0.5, 5, SEED), c)
    train = lab.where("is_train")
    prep = P.FeaturePrep(NUMERIC, CATEGORICAL).fit(train)
    stats = P.fit_standardize(train, NUMERIC)
    full = with_indicators(P.apply_standardize(prep.transform(lab), stats)).withColumn("label", F.col("label").cast("double"))
    return full.where("is_train"), full.where(~F.col("is_train")), prep


# ----------------------------------------------------------- significance

@query("univariate_logit")
def q_univariate_logit(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y"))
    return S.univariate_logit(c, ALL, "label")


def _logodds_sql() -> str:
    return """
    WITH g AS (SELECT job, AVG(CASE WHEN y = 'yes' THEN 1.0 ELSE 0.0 END) AS p FROM clients
               WHERE job IS NOT NULL GROUP BY job),
    r AS (SELECT ln(p / (1 - p)) AS lo FROM g ORDER BY job LIMIT 1)
    SELECT 'job' AS model, 'Intercept' AS term, (SELECT lo FROM r) AS coefficient
    UNION ALL
    SELECT 'job', 'job[' || job || ']', ln(p / (1 - p)) - (SELECT lo FROM r) FROM g
    WHERE job <> (SELECT MIN(job) FROM g)"""


@query("univariate_logit_saturated", _logodds_sql(), rnd=("coefficient",), digits=5)
def q_univariate_logit_saturated(spark, sf_dir):
    """A logit on one categorical column is saturated: its coefficients are
    the log-odds of the reference category and the log odds ratios."""
    c = clients(spark, sf_dir).withColumn("label", yes_no("y"))
    return S.univariate_logit(c, ["job"], "label").select("model", "term", "coefficient")


@query("formula_ols", "SELECT 'duration ~ label' AS model, 'Intercept' AS term, "
       "regr_intercept(duration, label) AS coefficient FROM (SELECT duration, CASE WHEN y = 'yes' THEN 1 ELSE 0 END "
       "AS label FROM clients) AS _c UNION ALL SELECT 'duration ~ label', 'label', regr_slope(duration, label) "
       "FROM (SELECT duration, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM clients) AS _d",
       rnd=("coefficient",), digits=6)
def q_formula_ols(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y").cast("double"))
    return S.formula_ols(c, "duration ~ label").select("model", "term", "coefficient")


def _ols_job_sql() -> str:
    return """
    WITH g AS (SELECT job, COUNT(*) AS n, AVG(duration) AS m FROM clients WHERE job IS NOT NULL GROUP BY job),
    r AS (SELECT job AS rjob, n AS rn, m AS rm FROM g ORDER BY job LIMIT 1),
    s2 AS (SELECT SUM(pow(c.duration - g.m, 2)) / (SUM(1) - (SELECT COUNT(*) FROM g)) AS v
           FROM clients c JOIN g ON c.job = g.job)
    SELECT 'duration ~ job' AS model, 'Intercept' AS term, r.rm AS coefficient, sqrt(s2.v / r.rn) AS std_error
    FROM r, s2
    UNION ALL
    SELECT 'duration ~ job', 'job_' || g.job, g.m - r.rm, sqrt(s2.v * (1.0 / g.n + 1.0 / r.rn))
    FROM g, r, s2 WHERE g.job <> r.rjob"""


@query("formula_ols_categorical", _ols_job_sql(), rnd=("coefficient", "std_error"))
def q_formula_ols_categorical(spark, sf_dir):
    """OLS on one categorical column: coefficients are group-mean
    differences, standard errors come from the pooled residual variance."""
    c = clients(spark, sf_dir)
    return S.formula_ols(c, "duration ~ job").select("model", "term", "coefficient", "std_error")


@query("formula_ols_table")
def q_formula_ols_table(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y").cast("double"))
    return S.coef_table(S.formula_ols(c, "duration ~ job"), S.formula_ols(c, "duration ~ label"),
                        S.formula_ols(c, "duration ~ job + contact + education + month + balance + amount + day + campaign + label"))


@query("formula_logit")
def q_formula_logit(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y").cast("double"))
    return S.coef_table(S.formula_logit(c, "label ~ duration"), S.formula_logit(c, "label ~ balance"),
                        S.formula_logit(c, "label ~ job + contact + education + month + balance + amount + day + duration "
                                           "+ campaign"))


@query("coef_table")
def q_coef_table(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y"))
    return S.coef_table(S.univariate_logit(c, ["job", "balance", "duration"], "label"))


# ------------------------------------------------------------- estimators

def _preds(model, test) -> DataFrame:
    return model.transform(test).select("client_id", F.col("label").cast("int").alias("label"),
                                        F.col("prediction").cast("int").alias("prediction"))


@query("logistic_regression")
def q_logistic_regression(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    return _preds(LogisticRegression(maxIter=100).fit(train), test)


@query("random_forest_importance")
def q_random_forest_importance(spark, sf_dir):
    train, _, prep = prepared(spark, sf_dir)
    m = RandomForestClassifier(numTrees=100, seed=SEED).fit(train)
    return spark.createDataFrame(C.importance(m, prep.feature_names()), "feature string, importance double")


@query("boosted_trees")
def q_boosted_trees(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    m = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=SEED).fit(train)
    return _preds(m, test)


@query("linear_margin")
def q_linear_margin(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    return _preds(LinearSVC(maxIter=50, regParam=0.0, tol=1e-6).fit(train), test)


@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    return M.leaderboard(train, test, C.bakeoff(L2_FEATURES))


AP_SQL = (f"{BASE}, {_gnb_cte('sc', L2_FEATURES, 'nb', 'te')}, s AS (SELECT round(1 - prob0, 9) AS s, COUNT(*) AS n, SUM(label) AS pos FROM nb GROUP BY 1), "
          "u AS (SELECT pos, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp, SUM(pos) OVER () AS t FROM s WINDOW w AS (ORDER BY s DESC)) "
          "SELECT 'GaussianNB' AS model, SUM(pos / t * cp / cn) AS average_precision FROM u")


@query("average_precision", AP_SQL, rnd=("average_precision",))
def q_average_precision(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    m = C.GaussianNBClassifier(inputCols=L2_FEATURES).fit(train)
    scored = m.transform(test).withColumn("score", F.round(F.col("probability")[1], 9))
    ap = M.average_precision(scored, "label", "score")
    return spark.createDataFrame([("GaussianNB", float(ap))], "model string, average_precision double")


# ----------------------------------------------------------------- tuning

# Fixed values (the notebooks' grids): metric euclidean / manhattan x shrink threshold
# none (-1), 0.001, 0.01, 0.2, 0.5; var smoothing 1e-9 ... 1e-5; 50 seeded search trials
# over shrink threshold quniform(0.001, 0.5, 0.001); 100 trees; 5 folds.
SHRINKS = [None, 0.001, 0.01, 0.2, 0.5]
SMOOTHINGS = [1e-9, 1e-8, 1e-7, 1e-6, 1e-5]


def _centroids(points):
    """Fits all (metric, shrinkage) points from one set of moments per metric."""
    def fit_all(train):
        parts = {m: MD.centroid_parts(train, L2_FEATURES, "label", m) for m in dict.fromkeys(m for m, _ in points)}
        return [MD.shrunken(parts[m], s) for m, s in points]
    return fit_all


def _smoothings(train):
    first = MD.gaussian_nb(train, L2_FEATURES, "label", SMOOTHINGS[0])
    return [first.smoothed(s) for s in SMOOTHINGS]


def _ranked(spark, counts, params) -> DataFrame:
    """(candidate, params, mean_score, std_score) by balanced accuracy over the folds, best first."""
    score = (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)) + F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1))) / 2
    names = spark.createDataFrame([(i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(params)],
                                  "candidate int, params map<string,string>")
    got = counts.groupBy("candidate").agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))
    return names.join(got, "candidate").orderBy(F.desc("mean_score"), "candidate")


@query("grid_search")
def q_grid_search(spark, sf_dir):
    train, _, _ = prepared(spark, sf_dir)
    points = [(m, s) for m in ("euclidean", "manhattan") for s in SHRINKS]
    counts = T.fold_scores(train, _centroids(points))
    return _ranked(spark, counts, [{"metric": m, "shrinkThreshold": s} for m, s in points])


@query("grid_search_nb")
def q_grid_search_nb(spark, sf_dir):
    train, _, _ = prepared(spark, sf_dir)
    return _ranked(spark, T.fold_scores(train, _smoothings), [{"varSmoothing": s} for s in SMOOTHINGS])


@query("param_search")
def q_param_search(spark, sf_dir):
    """50 trials of the learning search, by recall of class 1 on held-out
    folds (the replaced objective); a batch's points share their scans."""
    train, _, _ = prepared(spark, sf_dir)
    space = {"metric": T.choice("euclidean", "manhattan"), "shrinkThreshold": T.quniform(0.001, 0.5, 0.001)}

    def recall(points, fold):
        counts = T.fold_scores(train, _centroids([(p["metric"], float(p["shrinkThreshold"])) for p in points]), only=[fold])
        return [r.tp / max(r.tp + r.fn, 1) for r in counts.orderBy("candidate").collect()]
    search = Search(space, lambda points, fold: [0.0] * len(points), folds=2, evals=50, seed=SEED)
    search.set_objective(recall)
    search.run()
    return search.table(spark).select("trial", "round", F.col("params")["metric"].alias("metric"),
                                      F.col("params")["shrinkThreshold"].cast("double").alias("shrink_threshold"), "score", "folds", "stopped")


@query("logit_checked")
def q_logit_checked(spark, sf_dir):
    """The full logit with collinear and separating terms named: the month's
    quarter repeats the months."""
    c = clients(spark, sf_dir).withColumn("label", yes_no("y").cast("double")).withColumn("quarter", F.floor((F.col("month").cast("int") + 2) / 3).cast("string"))
    return RC.checked_logit(c, "label ~ job + contact + month + quarter + balance + amount + day + duration + campaign")


def _cv_sql() -> str:
    f = NUMERIC
    folds = " + ".join(f"CAST(_rank > (ntr * {j}) // 5 AS INTEGER)" for j in range(1, 5))
    st = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in f)
    z = ", ".join(f"(CAST(t.{c} AS DOUBLE) - st.m_{c}) / CASE WHEN st.s_{c} > 0 THEN st.s_{c} ELSE 1 END AS {c}"
                  for c in f)
    cent = ", ".join(f"AVG(z.{c}) AS m_{c}" for c in L2_FEATURES)
    dist = " + ".join(f"pow(z.{c} - k.m_{c}, 2)" for c in L2_FEATURES)
    return f"""
    WITH lab AS (SELECT *, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM clients),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(client_id AS VARCHAR) || '{SEED}'),
                                        client_id) AS _rank,
                  CAST(round(COUNT(*) OVER (PARTITION BY label) * 0.5) AS BIGINT) AS ntr FROM lab),
    tr AS (SELECT *, {folds} AS fold FROM rk WHERE _rank <= ntr),
    st AS (SELECT {st} FROM tr),
    z AS (SELECT t.client_id, t.label, t.fold, {z}, {indicators_sql()} FROM tr t, st),
    k AS (SELECT o.k AS held, z.label AS c, {cent} FROM z, (SELECT DISTINCT fold AS k FROM z) o
          WHERE z.fold <> o.k GROUP BY o.k, z.label),
    d AS (SELECT z.client_id, z.label, z.fold, k.c, -({dist}) AS s FROM z JOIN k ON k.held = z.fold),
    pred AS (SELECT client_id, label, fold, FIRST(c ORDER BY s DESC, c) AS prediction FROM d
             GROUP BY client_id, label, fold),
    acc AS (SELECT fold, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred
            GROUP BY fold)
    SELECT fold, accuracy FROM acc UNION ALL SELECT -1 AS fold, AVG(accuracy) AS accuracy FROM acc"""


@query("cv_score", _cv_sql(), rnd=("accuracy",))
def q_cv_score(spark, sf_dir):
    train, _, _ = prepared(spark, sf_dir)
    return T.cv_score(C.NearestCentroidClassifier(inputCols=L2_FEATURES), train, 5)


@query("stacking")
def q_stacking(spark, sf_dir):
    train, test, _ = prepared(spark, sf_dir)
    bases = {"nc": C.NearestCentroidClassifier(inputCols=L2_FEATURES),
             "nb": C.GaussianNBClassifier(inputCols=L2_FEATURES),
             "qda": C.QDAClassifier(inputCols=L2_FEATURES, regParam=1.0)}
    return T.stack(bases, train, test, 5)
