"""Dimension reduction and segmentation of the positive class.

The reductions fit small matrices (p x p Gramians, p x k bases) with
distributed aggregates and apply them as per-row vector products; k-means
variants iterate on a cached vector frame. Cluster ids and component signs
are canonicalised so results do not depend on random starts or the
eigen-solver's sign choice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 6932


def _signs(basis: np.ndarray) -> list[float]:
    """+1/-1 per component so that its largest-magnitude loading is positive."""
    out = []
    for j in range(basis.shape[1]):
        i = int(np.argmax(np.abs(basis[:, j])))
        out.append(-1.0 if basis[i, j] < 0 else 1.0)
    return out


def _signed(df: DataFrame, raw: str, signs: list[float], out: str, names: list[str] | None = None) -> DataFrame:
    """Apply component signs to a projected vector (k cheap column products)."""
    arr = vector_to_array(F.col(raw))
    comps = [arr[j] * F.lit(sg) for j, sg in enumerate(signs)]
    df = df.withColumn(out, array_to_vector(F.array(*comps)))
    if names:
        oarr = vector_to_array(F.col(out))
        df = df.select("*", *[oarr[j].alias(n) for j, n in enumerate(names)])
    return df.drop(raw)


def svd_fit(df: DataFrame, features: str, k: int):
    """Right singular vectors of the uncentred feature matrix X.

    Every row enters twice, as x and -x: the mirrored set has mean 0, so its
    covariance is X'X / (2n - 1) and Spark's PCA (a JVM tree aggregate of the
    p x p Gramian, then a local eigen-decomposition) returns exactly the right
    singular vectors of X. Only p x p numbers reach the driver. Returns the
    fitted ``PCAModel`` (its transform is the uncentred projection x . V,
    computed natively in the JVM) and the sign fix per component.
    """
    sign = df.select(features).withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    mirrored = sign.select(array_to_vector(F.transform(vector_to_array(F.col(features)),
                                                       lambda v: v * F.col("_s"))).alias("_m"))
    model = PCA(k=k, inputCol="_m", outputCol="_o").fit(mirrored)
    return model, _signs(np.array(model.pc.toArray()))


def svd_basis(df: DataFrame, features: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(p x k sign-fixed basis, share of X'X's trace per component)."""
    model, signs = svd_fit(df, features, k)
    return np.array(model.pc.toArray()) * np.array(signs), np.array(model.explainedVariance.toArray())


def svd_project(df: DataFrame, features: str, k: int, out: str = "svd", fit_on: DataFrame | None = None) -> DataFrame:
    """Project onto k SVD components fitted on ``fit_on`` (default: df), as a vector column."""
    model, signs = svd_fit(fit_on if fit_on is not None else df, features, k)
    raw = model.copy().setInputCol(features).setOutputCol("_svd_raw").transform(df)
    return _signed(raw, "_svd_raw", signs, out)


def svd_variance(df: DataFrame, features: str, k: int | None = None) -> DataFrame:
    """Explained-variance ratio of each of k SVD components (all but the last
    if k is not given) and the running total: (component, explained_variance,
    ratio, cumulative). The variances of the projected columns and of the
    features come from one vector aggregate each."""
    first = df.select(features).first()
    k = k or max(1, len(first[0]) - 1)
    proj = svd_project(df, features, k, "_z")
    row = proj.agg(Summarizer.metrics("count", "variance").summary(F.col("_z")).alias("z"),
                   Summarizer.metrics("variance").summary(F.col(features)).alias("x")).first()
    back = (row["z"]["count"] - 1) / row["z"]["count"]                # sample -> population
    each, total = row["z"]["variance"].toArray() * back, float(np.sum(row["x"]["variance"].toArray())) * back
    rows, cum = [], 0.0
    for j in range(k):
        ev = float(each[j])
        ratio = ev / total if total else 0.0
        cum += ratio
        rows.append((j + 1, float(ev), float(ratio), float(cum)))
    return df.sparkSession.createDataFrame(rows, "component int, explained_variance double, ratio double, "
                                                 "cumulative double")


def pca_project(df: DataFrame, features: str, k: int = 2, out: str = "pca", fit_on: DataFrame | None = None):
    """Centre (Spark's PCA does not), fit PCA, project natively, fix the
    component signs. Adds ``out`` (vector) and ``pc1..pck``; returns
    (frame, sign-fixed loadings)."""
    src = fit_on if fit_on is not None else df
    centre = StandardScaler(inputCol=features, outputCol="_c", withMean=True, withStd=False).fit(src)
    pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(src))
    basis = np.array(pca.pc.toArray())
    signs = _signs(basis)
    proj = pca.transform(centre.transform(df)).drop("_c")
    proj = _signed(proj, "_p", signs, out, [f"pc{j + 1}" for j in range(k)])
    return proj, basis * np.array(signs)


def _canonical_labels(df: DataFrame, raw: str, out: str, features: str) -> DataFrame:
    """Renumber cluster ids by size (largest first), then by centroid, so the
    numbering is stable across seeds and engines; the mapping has k rows."""
    stats = (df.groupBy(raw).agg(F.count(F.lit(1)).alias("n"),
                                 Summarizer.mean(F.col(features)).alias("c"))
             .collect())
    order = sorted(stats, key=lambda r: (-r["n"], tuple(r["c"].toArray())))
    mapping = {r[raw]: i for i, r in enumerate(order)}
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(raw) == k, v) if expr is None else expr.when(F.col(raw) == k, v)
    return df.withColumn(out, expr.cast("int"))


def kmeans(df: DataFrame, features: str, k: int, seed: int = SEED, out: str = "cluster", max_iter: int = 50):
    """Seeded k-means (k-means|| init) with canonical cluster numbering."""
    model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="_raw", maxIter=max_iter).fit(df)
    labelled = _canonical_labels(model.transform(df), "_raw", out, features).drop("_raw")
    return labelled, model


def total_ss(df: DataFrame, features: str) -> float:
    """Sum of squared distances to the overall mean (inertia of k = 1): the
    variances times n - 1, from one vector aggregate."""
    r = df.agg(Summarizer.metrics("count", "variance").summary(F.col(features)).alias("s")).first()["s"]
    return float(np.sum(r["variance"].toArray()) * max(r["count"] - 1, 0))


def elbow(df: DataFrame, features: str, k_min: int = 1, k_max: int = 9, seed: int = SEED) -> DataFrame:
    """Inertia for each k (k = 1 in closed form; Spark needs k > 1)."""
    rows = []
    cached = df.select(features).cache()
    for k in range(k_min, k_max + 1):
        if k == 1:
            rows.append((1, total_ss(cached, features)))
        else:
            m = KMeans(k=k, seed=seed, featuresCol=features, maxIter=50).fit(cached)
            rows.append((k, float(m.summary.trainingCost)))
    cached.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def bisecting(df: DataFrame, features: str, k: int, seed: int = SEED, out: str = "cluster"):
    """Divisive hierarchical segmentation (bisecting k-means)."""
    model = BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="_raw").fit(df)
    return _canonical_labels(model.transform(df), "_raw", out, features).drop("_raw"), model


def cluster_compare(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts of two labelings, long form (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
