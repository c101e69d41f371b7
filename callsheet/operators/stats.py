"""Regressions with significance tables: univariate logits, formula OLS and
formula logits, and the coefficient table with significance stars.

Design for scale: a logit on one categorical column is saturated and is
solved in closed form from cell counts (all columns in one grouped count);
a logit on one numeric column is fitted on one row per distinct value
``(x, share of positives, n)`` with ``n`` as the number of binomial trials,
which gives exactly the row-level estimates and standard errors while the
IRLS passes run over far fewer rows. Multivariate fits use Spark's
distributed normal equations / IRLS directly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.columns import stars
from callsheet.session import persist

GLM_TOL = 1e-10
GLM_MAX_ITER = 100


def _terms_from_meta(df: DataFrame, features: str) -> list[str]:
    """Slot names of a vector column from its ML attribute metadata."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    attrs.sort(key=lambda a: a["idx"])
    return [a["name"] for a in attrs]


def _summary_rows(model_name: str, terms: list[str], summary, coefficients, intercept) -> list[tuple]:
    """(model, term, coefficient, std_error, p_value); Spark lists the
    intercept last in the summary arrays."""
    se = list(summary.coefficientStandardErrors)
    pv = list(summary.pValues)
    rows = [(model_name, "Intercept", float(intercept), float(se[-1]), float(pv[-1]))]
    for i, t in enumerate(terms):
        rows.append((model_name, t, float(coefficients[i]), float(se[i]), float(pv[i])))
    return rows


COEF_SCHEMA = "model string, term string, coefficient double, std_error double, p_value double"


def _saturated_logits(df: DataFrame, cats: Sequence[str], label: str) -> list[tuple]:
    """Logits of the label on each categorical column alone, in closed form.

    With drop-first dummies the model is saturated, so the maximum-likelihood
    fit is exact from the cell counts: intercept = log-odds of the reference
    (alphabetically first) category, coefficient = log odds ratio against it,
    standard errors sqrt(1/a + 1/b [+ 1/a_ref + 1/b_ref]) and two-sided
    normal p-values, as the binomial GLM reports them. All columns come from
    one grouped count (one pass, one small shuffle); only the cell counts
    (bounded by the number of categories) reach the driver.
    """
    from callsheet.operators.explore import count_by
    cells = (count_by(df.withColumn("_yl", F.col(label).cast("int")), cats, "_yl")
             .collect())
    table: dict[str, dict[str, list[int]]] = {}
    for r in cells:
        table.setdefault(r["feature"], {}).setdefault(r["value"], [0, 0])[int(r["_yl"])] = int(r["n"])

    def logit(neg, pos):
        return math.log(pos / neg) if neg > 0 and pos > 0 else float("nan")

    def pval(z):
        return math.erfc(abs(z) / math.sqrt(2.0)) if not math.isnan(z) else float("nan")

    rows = []
    for c in cats:
        levels = sorted(table.get(c, {}))
        if not levels:
            continue
        ref_neg, ref_pos = table[c][levels[0]]
        b0 = logit(ref_neg, ref_pos)
        se0 = math.sqrt(1 / ref_neg + 1 / ref_pos) if ref_neg and ref_pos else float("nan")
        rows.append((c, "Intercept", b0, se0, pval(b0 / se0) if se0 == se0 and se0 > 0 else float("nan")))
        for v in levels[1:]:
            neg, pos = table[c][v]
            b = logit(neg, pos) - b0
            se = (math.sqrt(1 / neg + 1 / pos + 1 / ref_neg + 1 / ref_pos)
                  if neg and pos and ref_neg and ref_pos else float("nan"))
            rows.append((c, f"{c}[{v}]", b, se, pval(b / se) if se == se and se > 0 else float("nan")))
    return rows


def univariate_logit(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Logit of the 0/1 label on each column alone, long form:
    (model, term, coefficient, std_error, p_value) with model = the column.

    Categorical columns enter as drop-first dummies (the alphabetically first
    category is the reference) and are solved in closed form together.
    Numeric columns are fitted by Spark's binomial GLM (IRLS) on one row per
    distinct value (share of positives, number of trials as weight), which
    gives the row-level estimates and standard errors from far fewer rows.
    """
    spark: SparkSession = df.sparkSession
    types = dict(df.dtypes)
    cats = [c for c in cols if types[c] == "string"]
    nums = [c for c in cols if types[c] != "string"]
    base = persist(df.select(*cols, label).where(F.col(label).isNotNull()))
    rows = _saturated_logits(base, cats, label) if cats else []
    for c in nums:
        # kept because every IRLS iteration scans it
        grouped = persist(base.where(F.col(c).isNotNull())
                          .groupBy(c).agg(F.avg(F.col(label).cast("double")).alias(label),
                                          F.count(F.lit(1)).cast("double").alias("_w")))
        data = VectorAssembler(inputCols=[c], outputCol="_x").transform(
            grouped.withColumn(c, F.col(c).cast("double")))
        glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x",
                                          labelCol=label, weightCol="_w", tol=GLM_TOL, maxIter=GLM_MAX_ITER)
        m = glm.fit(data)
        rows += _summary_rows(c, [c], m.summary, m.coefficients, m.intercept)
        grouped.unpersist()
    base.unpersist()
    order = {c: i for i, c in enumerate(cols)}
    rows.sort(key=lambda r: order[r[0]])
    return spark.createDataFrame(rows, COEF_SCHEMA)


def _formula_fit(df: DataFrame, formula: str, estimator, name: str) -> DataFrame:
    rf = RFormula(formula=formula, featuresCol="_x", labelCol="_y", stringIndexerOrderType="alphabetDesc",
                  handleInvalid="skip")
    prepared = persist(rf.fit(df).transform(df).select("_x", "_y"))   # scanned once per iteration
    model = estimator.setFeaturesCol("_x").setLabelCol("_y").fit(prepared)
    terms = _terms_from_meta(prepared, "_x")
    rows = _summary_rows(name, terms, model.summary, model.coefficients, model.intercept)
    prepared.unpersist()
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA)


def formula_ols(df: DataFrame, formula: str, name: str | None = None) -> DataFrame:
    """Ordinary least squares by R formula (normal-equation solver, so the
    summary carries standard errors and p-values)."""
    return _formula_fit(df, formula, LinearRegression(solver="normal", regParam=0.0), name or formula)


def formula_logit(df: DataFrame, formula: str, name: str | None = None) -> DataFrame:
    """Binomial GLM (logit link) by R formula; the response must be 0/1."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", tol=GLM_TOL, maxIter=GLM_MAX_ITER)
    return _formula_fit(df, formula, glm, name or formula)


def coef_table(*tables: DataFrame) -> DataFrame:
    """Stack coefficient tables of several models and add significance stars."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.withColumn("stars", stars("p_value"))
