"""What makes a regression's coefficients meaningless: collinear terms and
separated classes, found before the fit and named.

Collinear: the columns of the formula's matrix, centred and scaled to length 1,
give a p x p Gramian by one pass (tasks hand on p x p sums). A factorisation
takes the terms in the formula's order; one whose rest, after what the earlier
terms explain, is under ``TOLERANCE`` is a combination of them, and these are
named. A constant column is a combination of the intercept.

Separated (0/1 response): a term alone separates if one class lies wholly on one
side of a value (a level of a category with one class does), which one grouped
aggregate of least and greatest values shows; all terms together do if a fit
with a faint penalty puts every row on its side, which one more aggregate
verifies. In both cases the likelihood has no maximum.

``checked_ols`` and ``checked_logit`` fit what can be fitted: a collinear term has
no coefficient and says so in ``note``; a separating term has its sign as
infinity, and the others are fitted without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RFormula, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.operators.stats import COEF_SCHEMA, GLM_MAX_ITER, GLM_TOL, _summary_rows, _terms_from_meta
from callsheet.session import persist

TOLERANCE = 1e-9
CHECKS = "term string, issue string, detail string"


def _matrix(df: DataFrame, formula: str) -> tuple[DataFrame, list[str]]:
    rf = RFormula(formula=formula, featuresCol="_x", labelCol="_y", stringIndexerOrderType="alphabetDesc", handleInvalid="skip")
    got = persist(rf.fit(df).transform(df).select("_x", "_y"))
    return got, _terms_from_meta(got, "_x")


def gramian(rows: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(Gramian of the centred columns scaled to length 1, their lengths)."""
    s = rows.agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_x")).alias("s")).first()["s"]
    if not s["count"]:
        return np.zeros((p, p)), np.zeros(p)
    mean, length = s["mean"].toArray(), np.sqrt(s["variance"].toArray() * max(s["count"] - 1, 0))
    scale = np.where(length > 0, length, 1.0)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            x = batch.column("x")
            v = (x.values.to_numpy()[x.offsets[0].as_py():x.offsets[-1].as_py()].reshape(-1, p) - mean) / scale
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(p), p).astype(np.int32)), pa.array(np.tile(np.arange(p), p).astype(np.int32)),
                                          pa.array(total.ravel())], ["i", "j", "v"])
    got = rows.select(vector_to_array("_x").alias("x")).mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((p, p))
    for r in got.collect():
        out[r.i, r.j] = r.v
    return out, length


def dependent(gram: np.ndarray, length: np.ndarray, tolerance: float = TOLERANCE) -> dict[int, list[int]]:
    """Columns that earlier ones explain, with these."""
    kept: list[int] = []
    out: dict[int, list[int]] = {}
    for j in range(len(length)):
        if not length[j] > 0:
            out[j] = []
            continue
        if kept:
            b = np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, j])
            if gram[j, j] - b @ gram[kept, j] < tolerance:
                out[j] = [k for k, w in zip(kept, b) if abs(w) > 1e-6]
                continue
        kept.append(j)
    return out


def separating(rows: DataFrame, p: int) -> dict[int, float]:
    """Terms that alone leave one class on one side of a value, with the sign of their coefficient."""
    ends = {r["_y"]: (r["lo"].toArray(), r["hi"].toArray()) for r in rows.groupBy("_y").agg(Summarizer.min(F.col("_x")).alias("lo"), Summarizer.max(F.col("_x")).alias("hi")).collect()}
    if len(ends) != 2:
        return {}
    (lo0, hi0), (lo1, hi1) = (ends[y] for y in sorted(ends))
    out = {}
    for j in range(p):
        if max(hi0[j], hi1[j]) == min(lo0[j], lo1[j]):
            continue
        if hi0[j] <= lo1[j]:
            out[j] = 1.0
        elif hi1[j] <= lo0[j]:
            out[j] = -1.0
    return out


def _jointly(rows: DataFrame, terms: list[int]) -> bool:
    """Whether all terms together put every row on its side (a certificate, not a guess)."""
    if not terms:
        return False
    x = VectorSlicer(inputCol="_x", outputCol="_s", indices=terms).transform(rows)
    m = LogisticRegression(featuresCol="_s", labelCol="_y", regParam=1e-8, maxIter=200, tol=1e-12).fit(x)
    margin = vector_to_array(F.col("rawPrediction"))[1] * (2 * F.col("_y") - 1)
    return (m.transform(x).agg(F.min(margin).alias("m")).first().m or 0.0) > 0


def formula_checks(df: DataFrame, formula: str, binary: bool = True) -> DataFrame:
    """(term, issue, detail): constant, collinear, separates, separated (all terms together)."""
    rows, terms = _matrix(df, formula)
    found = _issues(rows, terms, binary)[2]
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, CHECKS)


def _issues(rows: DataFrame, terms: list[str], binary: bool) -> tuple[dict, dict, list[tuple]]:
    bad = dependent(*gramian(rows, len(terms)))
    found = [(terms[j], "collinear" if by else "constant", ", ".join(terms[k] for k in by)) for j, by in bad.items()]
    alone: dict[int, float] = {}
    if binary:
        alone = {j: s for j, s in separating(rows, len(terms)).items() if j not in bad}
        found += [(terms[j], "separates", "label 1 above" if s > 0 else "label 1 below") for j, s in alone.items()]
        if not alone and rows.select("_y").distinct().count() == 2 and _jointly(rows, [j for j in range(len(terms)) if j not in bad]):
            found.append(("", "separated", "by all terms together"))
    return bad, alone, found


def _checked(df: DataFrame, formula: str, binary: bool) -> DataFrame:
    rows, terms = _matrix(df, formula)
    bad, alone, found = _issues(rows, terms, binary)
    notes = {t: f"{issue}: {detail}" if detail else issue for t, issue, detail in found}
    use = [j for j in range(len(terms)) if j not in bad and j not in alone]
    nan = float("nan")
    out = [(formula, terms[j], nan, nan, nan, notes[terms[j]]) for j in bad] + [(formula, terms[j], s * float("inf"), nan, nan, notes[terms[j]]) for j, s in alone.items()]
    if use and "" not in notes and not rows.isEmpty():
        x = VectorSlicer(inputCol="_x", outputCol="_s", indices=use).transform(rows)
        est = GeneralizedLinearRegression(family="binomial", link="logit", tol=GLM_TOL, maxIter=GLM_MAX_ITER) if binary else LinearRegression(solver="normal", regParam=0.0)
        m = est.setFeaturesCol("_s").setLabelCol("_y").fit(x)
        out += [(*r, None) for r in _summary_rows(formula, [terms[j] for j in use], m.summary, m.coefficients, m.intercept)]
    elif "" in notes:
        out += [(formula, terms[j], nan, nan, nan, notes[""]) for j in use]
    rows.unpersist()
    place = {t: i for i, t in enumerate(["Intercept", *terms])}
    return df.sparkSession.createDataFrame(sorted(out, key=lambda r: place[r[1]]), f"{COEF_SCHEMA}, note string")


def checked_ols(df: DataFrame, formula: str) -> DataFrame:
    """Ordinary least squares with a note for each term that can't be told apart."""
    return _checked(df, formula, False)


def checked_logit(df: DataFrame, formula: str) -> DataFrame:
    """Logit with a note for each term that is collinear or separates the classes."""
    return _checked(df, formula, True)
