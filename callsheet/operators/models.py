"""Closed-form classifiers fitted by one grouped aggregate each.

Fitting reduces the training frame to per-class moments (a handful of rows:
classes x features), which the driver turns into literal coefficients; the
scoring is then a pure column expression, so prediction is a narrow,
codegen'd projection with no join and no Python on the executors. The same
expressions run on a streaming frame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.functions.columns import Levels
from callsheet.session import persist

# One path for every width: fits use the vector Summarizer, scores fold a
# constant array with the row's features, in time linear in their number.
# The 0/1 columns of a text column may be given as ``Levels``: a fit counts
# them, and a score looks up what a row's level adds.
# Null rule: a row with a null feature (or label) takes no part in a fit and
# gets a null prediction.

Features = Sequence[str | Levels]


def _parts(features: Features) -> tuple[dict[int, str], dict[int, Levels]]:
    """Plain columns by their place, and level groups by the place of their first level."""
    plain, groups, at = {}, {}, 0
    for f in features:
        if isinstance(f, Levels):
            groups[at] = f
            at += len(f.levels)
        else:
            plain[at] = f
            at += 1
    return plain, groups


def _width(features: Features) -> int:
    return sum(len(f.levels) if isinstance(f, Levels) else 1 for f in features)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, in whatever filter or
    projection the optimiser puts the expression."""
    return F.transform(F.array(value), body)[0]


def _argmax(scores: dict[int, Column]) -> Column:
    """Class of the highest score; ties go to the smallest class."""
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-c).alias("nc")) for c, s in scores.items()]) \
        if len(scores) > 1 else F.struct(list(scores.values())[0].alias("s"), F.lit(-list(scores)[0]).alias("nc"))
    return (-best["nc"]).cast("int")


def _argmin(scores: dict[int, Column]) -> Column:
    """Class of the lowest score; ties go to the smallest class."""
    best = F.least(*[F.struct(s.alias("s"), F.lit(c).alias("c")) for c, s in scores.items()]) \
        if len(scores) > 1 else F.struct(list(scores.values())[0].alias("s"), F.lit(list(scores)[0]).alias("c"))
    return best["c"].cast("int")


def _softmax(scores: dict[int, Column]) -> Column:
    """Array of class probabilities (class order) from log-scores."""
    m = F.greatest(*scores.values()) if len(scores) > 1 else list(scores.values())[0]
    exps = [F.exp(s - m) for s in scores.values()]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return F.array(*[e / total for e in exps])


def _score(df: DataFrame, features: Features, scores, prediction: str, probability: str) -> DataFrame:
    """Argmax and softmax of the class scores (``scores(x)`` by class, of the
    feature array ``x``), each score evaluated once; null for an incomplete row."""
    both = F.struct(F.lit(None).cast("int").alias("c"), F.lit(None).cast("array<double>").alias("p"))
    got = F.when(_complete(features), _of_scores(features, scores, lambda s: F.struct(_argmax(s).alias("c"), _softmax(s).alias("p")))).otherwise(both)
    df = df.withColumn("_scored", got)
    return df.withColumn(prediction, F.col("_scored")["c"]).withColumn(probability, F.col("_scored")["p"]).drop("_scored")


def _of_scores(features: Features, scores, body) -> Column:
    """``body`` of the class scores of a row: the feature array and every score are evaluated once."""
    classes: list[int] = []

    def scored(x: Column) -> Column:
        by = scores(x)
        classes[:] = by
        return F.array(*by.values())

    return _let(_let(_x_array(features), scored), lambda s: body({c: s[i] for i, c in enumerate(classes)}))


def _complete(features: Features) -> Column:
    """Whether a row has all its features (a level is never missing)."""
    plain, _ = _parts(features)
    return F.forall(F.array(*[F.col(f).isNotNull() for f in plain.values()]), lambda x: x) if plain else F.lit(True)


def _class_moments(train: DataFrame, features: Features, label: str) -> list[dict]:
    """Per-class count, means and population variances: one grouped vector
    aggregate (one pass with running updates, so large means cost no digits),
    one row per class. Levels are counted: one row per class and level."""
    plain, groups = _parts(features)
    names = list(plain.values())
    vec = array_to_vector(F.array(*[F.col(f).cast("double") for f in names] or [F.lit(0.0)]))
    summ = Summarizer.metrics("count", "mean", "variance", "min", "max", "numNonZeros", "normL1").summary(vec).alias("_s")
    out = []
    full = train.dropna(subset=[label, *names])
    counts = {}
    if groups:
        rows = F.array(*[F.struct(F.lit(j).alias("_g"), g.number().alias("_i")) for j, g in groups.items()])
        counts = {(r[label], r["_g"], r["_i"]): r["n"] for r in full.select(label, F.inline(rows))
                  .groupBy(label, "_g", "_i").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in full.groupBy(label).agg(summ).collect():
        s = r["_s"]
        n = int(s["count"])
        d = {label: r[label], "_n": n}
        mean, var = s["mean"].toArray(), s["variance"].toArray()
        ones, total = s["numNonZeros"].toArray(), s["normL1"].toArray()
        # 0/1 columns: nothing outside [0, 1], and as many non-zeros as their sum
        d["_ones"] = {j: int(ones[k]) for k, j in enumerate(plain) if s["min"][k] >= 0 and s["max"][k] <= 1 and ones[k] == total[k]}
        for k, j in enumerate(plain):
            d[f"m_{j}"] = float(mean[k])
            d[f"v_{j}"] = float(var[k]) * (n - 1) / n if n > 1 else 0.0   # sample -> population
        for at, g in groups.items():
            for i in range(len(g.levels)):
                ones_i = counts.get((r[label], at, i + 1), 0)
                d["_ones"][at + i] = ones_i
                d[f"m_{at + i}"] = ones_i / n
                d[f"v_{at + i}"] = ones_i * (n - ones_i) / n ** 2
        out.append(d)
    return sorted(out, key=lambda r: r[label])


def _x_array(features: Features) -> Column:
    """Plain features, then the level numbers of the groups."""
    plain, groups = _parts(features)
    return F.array(*[F.col(f).cast("double") for f in plain.values()], *[g.number().cast("double") for g in groups.values()])


def _const_array(values) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")   # one parse, not a call per number


def _loop_sum(x: Column, features: Features, start: float, centre, scale, kind: str) -> Column:
    """start - sum_j term_j, folded left to right like the explicit form:
    kind 'gauss': (x_j - c_j)^2 / s_j subtracted; 'sq' / 'abs': distances added.
    What the 0/1 columns of a group add together is one constant per level."""
    plain, groups = _parts(features)
    scale = [1.0] * len(centre) if scale is None else scale
    row = F.slice(x, 1, len(plain)) if groups else x
    c = _const_array(centre[j] for j in plain)
    if not plain:
        out = F.lit(float(start))
    elif kind == "gauss":
        terms = F.zip_with(F.zip_with(row, c, lambda a, b: (a - b) * (a - b)), _const_array(scale[j] for j in plain), lambda a, d: a / d)
        out = F.aggregate(terms, F.lit(float(start)), lambda acc, t: acc - t)
    else:
        term = (lambda a, b: (a - b) * (a - b)) if kind == "sq" else (lambda a, b: F.abs(a - b))
        out = F.aggregate(F.zip_with(row, c, term), F.lit(0.0), lambda acc, t: acc + t)
    for k, (at, g) in enumerate(groups.items()):
        js = range(at, at + len(g.levels))
        alone = [(abs(centre[j]) if kind == "abs" else centre[j] ** 2) / scale[j] for j in js]
        here = [(abs(1 - centre[j]) if kind == "abs" else (1 - centre[j]) ** 2) / scale[j] for j in js]
        adds = _const_array([math.fsum(alone), *[math.fsum([*alone[:i], here[i], *alone[i + 1:]]) for i in range(len(js))]])
        add = F.get(adds, x[len(plain) + k].cast("int"))
        out = out - add if kind == "gauss" else out + add
    return out


# ------------------------------------------------------------ Gaussian NB

@dataclass
class GaussianNBModel:
    features: list[str | Levels]
    classes: list[int]
    log_prior: dict[int, float]
    means: dict[int, list[float]]
    variances: dict[int, list[float]]
    largest: float = 0.0
    var_smoothing: float = 0.0

    def smoothed(self, var_smoothing: float) -> GaussianNBModel:
        """The same fit with another share of ``largest`` added to all variances."""
        more = (var_smoothing - self.var_smoothing) * self.largest
        return GaussianNBModel(self.features, self.classes, self.log_prior, self.means,
                               {c: [x + more for x in v] for c, v in self.variances.items()}, self.largest, var_smoothing)

    def predicted(self) -> Column:
        return F.when(_complete(self.features), _of_scores(self.features, self.scores, _argmax))

    def probability(self, of: int) -> Column:
        """Probability of one class; null for an incomplete row."""
        at = self.classes.index(of)
        return F.when(_complete(self.features), _of_scores(self.features, self.scores, lambda s: _softmax(s)[at]))

    def scores(self, x: Column) -> dict[int, Column]:
        """Joint log-likelihood per class of the feature array ``x``."""
        out = {}
        for c in self.classes:
            const = self.log_prior[c] - 0.5 * sum(math.log(2 * math.pi * v) for v in self.variances[c])
            out[c] = _loop_sum(x, self.features, const, self.means[c], [2 * v for v in self.variances[c]], "gauss")
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction",
                  probability: str = "probability") -> DataFrame:
        return _score(df, self.features, self.scores, prediction, probability)


def gaussian_nb(train: DataFrame, features: Features, label: str = "label",
                var_smoothing: float = 1e-9) -> GaussianNBModel:
    """Gaussian naive Bayes: class priors, means and population variances,
    every variance widened by ``var_smoothing`` x the largest feature
    variance of the whole training set (derived here from the class moments,
    so one pass suffices)."""
    features = list(features)
    rows = _class_moments(train, features, label)
    n_tot = sum(r["_n"] for r in rows)
    p = _width(features)
    total_var = []
    for j in range(p):
        mean_j = sum(r["_n"] * r[f"m_{j}"] for r in rows) / n_tot
        total_var.append(sum(r["_n"] * (r[f"v_{j}"] + (r[f"m_{j}"] - mean_j) ** 2) for r in rows) / n_tot)
    largest = max(total_var) or 1.0   # every column constant: no variance to take a share of
    eps = var_smoothing * largest
    classes = [int(r[label]) for r in rows]
    return GaussianNBModel(
        features, classes,
        {int(r[label]): math.log(r["_n"] / n_tot) for r in rows},
        {int(r[label]): [r[f"m_{j}"] for j in range(p)] for r in rows},
        {int(r[label]): [r[f"v_{j}"] + eps for j in range(p)] for r in rows}, largest, var_smoothing)


# ------------------------------------------------------- nearest centroid

@dataclass
class NearestCentroidModel:
    features: list[str | Levels]
    classes: list[int]
    centroids: dict[int, list[float]]
    metric: str = "euclidean"

    def distances(self, x: Column) -> dict[int, Column]:
        out = {}
        for c in self.classes:
            out[c] = _loop_sum(x, self.features, 0.0, self.centroids[c], None, "abs" if self.metric == "manhattan" else "sq")
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predicted())

    def predicted(self) -> Column:
        return F.when(_complete(self.features), _of_scores(self.features, self.distances, _argmin))


@dataclass
class CentroidParts:
    """What every nearest-centroid fit on one frame shares, whatever its shrinkage."""
    features: list[str | Levels]
    rows: list[dict]
    centres: dict[int, list[float]]
    metric: str


def centroid_parts(train: DataFrame, features: Features, label: str = "label", metric: str = "euclidean") -> CentroidParts:
    """Class moments and centres: means (euclidean) or medians (manhattan)."""
    features = list(features)
    rows = _class_moments(train, features, label)
    plain, _ = _parts(features)
    cent = {int(r[label]): [r[f"m_{j}"] for j in range(_width(features))] for r in rows}
    if metric == "manhattan":
        # class medians, exact, without gathering a class into one task; those
        # of 0/1 columns follow from their counts
        from callsheet.operators.quantiles import exact_quantiles
        for r in rows:
            for j, k in r["_ones"].items():
                cent[int(r[label])][j] = 0.5 if 2 * k == r["_n"] else float(2 * k > r["_n"])
        wide = [j for j in plain if any(j not in r["_ones"] for r in rows)]
        if wide:
            # kept as plain columns: the unpivot below would repeat every feature's expression
            plain = persist(train.dropna(subset=[label, *plain.values()]).select(label, *[F.col(plain[j]).cast("double").alias(f"_f{j}") for j in wide]))
            long = plain.select(label, F.inline(F.array(*[F.struct(F.lit(j).alias("_j"), F.col(f"_f{j}").alias("_x")) for j in wide])))
            for r in exact_quantiles(long, [label, "_j"], "_x", [0.5]).collect():
                cent[int(r[label])][int(r["_j"])] = r["q"]
            plain.unpersist()
    return CentroidParts(features, [{**r, "_c": int(r[label])} for r in rows], cent, metric)


def shrunken(parts: CentroidParts, shrink_threshold: float | None = None) -> NearestCentroidModel:
    """The model of given centres, with the optional nearest-shrunken-centroid
    soft threshold (Tibshirani et al., 2002): d = (class centroid - overall
    mean) / (m_k (s_j + s_0)) is shrunk towards 0 by ``shrink_threshold``."""
    rows, p = parts.rows, _width(parts.features)
    cent = {c: list(v) for c, v in parts.centres.items()}
    if shrink_threshold is not None:
        n = sum(r["_n"] for r in rows)
        k = len(rows)
        overall = [sum(r["_n"] * r[f"m_{j}"] for r in rows) / n for j in range(p)]
        within = [sum(r["_n"] * r[f"v_{j}"] for r in rows) for j in range(p)]
        s = np.sqrt(np.maximum(np.array(within), 0.0) / max(n - k, 1))
        s = s + np.median(s)
        for r in rows:
            c = r["_c"]
            mk = math.sqrt(max(1.0 / r["_n"] - 1.0 / n, 0.0))
            new = []
            for j in range(p):
                ms = mk * s[j]
                d = (cent[c][j] - overall[j]) / ms if ms > 0 else 0.0
                d = math.copysign(max(abs(d) - shrink_threshold, 0.0), d)
                new.append(overall[j] + ms * d)
            cent[c] = new
    return NearestCentroidModel(parts.features, [r["_c"] for r in rows], cent, parts.metric)


def nearest_centroid(train: DataFrame, features: Features, label: str = "label",
                     metric: str = "euclidean", shrink_threshold: float | None = None) -> NearestCentroidModel:
    """Fit :func:`centroid_parts` and shrink them."""
    return shrunken(centroid_parts(train, features, label, metric), shrink_threshold)


# -------------------------------------------------------------------- QDA

@dataclass
class QDAModel:
    features: list[str]
    classes: list[int]
    log_prior: dict[int, float]
    means: dict[int, list[float]]
    rotations: dict[int, np.ndarray]
    scalings: dict[int, np.ndarray]

    def scores(self, x: Column) -> dict[int, Column]:
        """Joint log-likelihood per class of the feature array ``x``."""
        flat = all(np.allclose(sc, 1.0) for sc in self.scalings.values())
        if flat:
            return {c: _loop_sum(x, self.features, self._start(c), self.means[c], [2.0] * len(self.means[c]), "gauss") for c in self.classes}
        of = self._turned()(x)
        return {c: of[i] for i, c in enumerate(self.classes)}

    def _start(self, c: int) -> float:
        return self.log_prior[c] - 0.5 * float(np.sum(np.log(self.scalings[c])))

    def _turned(self):
        """Scores by rotations: matrix products over batches of rows, which
        expressions would fold number by number."""
        start, mean = [self._start(c) for c in self.classes], [np.array(self.means[c]) for c in self.classes]
        turn = [self.rotations[c] / np.sqrt(2 * self.scalings[c]) for c in self.classes]

        @F.arrow_udf("array<double>")
        def score(x: pa.Array) -> pa.Array:
            p = len(mean[0])
            whole = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            s = np.stack([c - (((whole - m) @ t) ** 2).sum(1) for c, m, t in zip(start, mean, turn)], 1)
            return pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1], pa.array(s.ravel()))
        return score

    def transform(self, df: DataFrame, prediction: str = "prediction",
                  probability: str = "probability") -> DataFrame:
        if all(np.allclose(sc, 1.0) for sc in self.scalings.values()):
            return _score(df, self.features, self.scores, prediction, probability)
        df = df.withColumn("_by", F.when(_complete(self.features), self._turned()(_x_array(self.features))))
        by = {c: F.col("_by")[i] for i, c in enumerate(self.classes)}
        there = F.col("_by").isNotNull()
        return df.withColumn(prediction, F.when(there, _argmax(by))).withColumn(probability, F.when(there, _softmax(by))).drop("_by")


#: least share of the largest eigenvalue that a direction is given: where a class does
#: not vary (the levels of a text column add up to one) it has a small spread, not none
FLAT = 1e-9


def qda(train: DataFrame, features: Sequence[str], label: str = "label", reg_param: float = 0.0) -> QDAModel:
    """Per-class Gaussian with covariance eigenvalues shrunk towards 1:
    w' = (1 - reg) w + reg, and at least ``FLAT`` of the largest of all classes.
    The sample covariances are sums of centred products, one pass for all of
    them, none for reg = 1, where all eigenvalues are 1; the p x p
    eigen-decomposition runs on the driver. Features are plain columns."""
    features = list(features)
    p = len(features)
    rows = _class_moments(train, features, label)
    cov = {r[label]: np.zeros((p, p)) for r in rows}
    if reg_param < 1:
        for c, s in _scatter(train, features, label, {r[label]: [r[f"m_{j}"] for j in range(p)] for r in rows}).items():
            cov[c] = s
        for r in rows:
            cov[r[label]] /= max(r["_n"] - 1, 1)
    n_tot = sum(r["_n"] for r in rows)
    turned = {r[label]: np.linalg.eigh(cov[r[label]]) if reg_param < 1 else (np.zeros(p), np.eye(p)) for r in rows}
    least = FLAT * (max((float(w.max()) for w, _ in turned.values()), default=0.0) or 1.0)
    classes, prior, means, rots, scs = [], {}, {}, {}, {}
    for r in rows:
        c = int(r[label])
        w, u = turned[r[label]]
        classes.append(c)
        prior[c] = math.log(r["_n"] / n_tot)
        means[c] = [r[f"m_{j}"] for j in range(p)]
        rots[c], scs[c] = u, np.maximum((1 - reg_param) * np.maximum(w, 0.0) + reg_param, least)
    return QDAModel(features, classes, prior, means, rots, scs)


def _scatter(train: DataFrame, features: Sequence[str], label: str, centre: dict) -> dict:
    """Per class the sums of products of the features, less the class's means:
    a task adds up its rows and hands on one row a class."""
    p = len(features)
    upper = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = np.stack([batch.column(f"_f{j}").to_numpy(zero_copy_only=False) for j in range(p)], 1)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for c, m in centre.items():
                d = x[y == c] - np.array(m)
                total[c] = total.get(c, 0.0) + d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array([float(c) for c in total], pa.float64()), pa.array([s[upper].tolist() for s in total.values()], pa.list_(pa.float64()))],
                                         ["_y", "_s"])
    full = train.dropna(subset=[label, *features]).select(F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_f{j}") for j, f in enumerate(features)])
    got = full.mapInArrow(sums, "_y double, _s array<double>").groupBy("_y").agg(Summarizer.sum(array_to_vector("_s")).alias("s")).collect()
    out = {}
    for c in centre:
        s = np.zeros((p, p))
        s[upper] = next((r["s"].toArray() for r in got if r["_y"] == c), 0.0)
        out[c] = s + np.triu(s, 1).T
    return out


# ----------------------------------------------------------------- voting

def vote(df: DataFrame, prediction_cols: Sequence[str], out: str = "prediction") -> DataFrame:
    """Hard majority vote of 0/1 predictions held in columns of one row."""
    total = None
    for c in prediction_cols:
        total = F.col(c) if total is None else total + F.col(c)
    return df.withColumn(out, (total > F.lit(len(prediction_cols) / 2.0)).cast("int"))


def majority(train: DataFrame, label: str = "label") -> int:
    """Most frequent class (ties: smallest) for the baseline predictor."""
    r = (train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
         .agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col(label).alias("c"))).alias("m")).first())
    return int(r["m"]["c"])
