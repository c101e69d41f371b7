"""Adaptive boosting (Freund and Schapire) with stumps for a 0/1 label.

A row's weight is an expression of the stumps made so far, so no weight is ever
stored or joined: a round is one grouped aggregate of the weights by (feature,
value bin, label), from which running sums give the weighted error of every cut
and side. Only features x bins sums reach the driver. A stump says 1 above its
cut or below it; its vote is rate * ln((1 - error) / error). Ties go to the
first feature, the lowest cut, then to 1 above. Training ends early when a stump
makes no error (it then decides alone) or none does better than half.

Rows without a label or a feature take no part in a fit; a row without a
feature that a stump asks for gets no prediction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.operators.boosting import hist_cuts
from callsheet.session import persist


@dataclass
class Stump:
    feature: str
    cut: float
    above: bool      # says 1 for values above the cut
    vote: float

    def says(self) -> Column:
        """+1 or -1."""
        high = F.col(self.feature).cast("double") > F.lit(float(self.cut))
        return F.when(high, 1.0 if self.above else -1.0).otherwise(F.when(F.col(self.feature).isNotNull(), -1.0 if self.above else 1.0))


@dataclass
class AdaptiveModel:
    stumps: list[Stump]

    def score(self) -> Column:
        """Sum of the votes, by the sum of their sizes: -1 to 1."""
        total = sum(abs(s.vote) for s in self.stumps) or 1.0
        out = F.lit(0.0)
        for s in self.stumps:
            out = out + F.lit(s.vote) * s.says()
        return out / F.lit(total)

    def transform(self, df: DataFrame, prediction: str = "prediction", score: str = "score") -> DataFrame:
        return df.withColumn(score, self.score()).withColumn(prediction, (F.col(score) > 0).cast("int"))


def _best(sums: dict[tuple[int, int], tuple[float, float]], cuts: list[list[float]]) -> tuple[float, int, float, bool]:
    """(error, feature, cut, above) of the least weighted error; sums hold the
    weights of label 0 and 1 by (feature, bin)."""
    best = None
    for f, values in enumerate(cuts):
        w = np.array([sums.get((f, b), (0.0, 0.0)) for b in range(len(values) + 1)])
        total = w.sum()
        if not total > 0:
            continue
        low = np.cumsum(w, axis=0)[:-1]
        for i, cut in enumerate(values):
            # says 1 above: wrong are label 1 below and label 0 above
            wrong = (low[i, 1] + w[:, 0].sum() - low[i, 0]) / total
            for above, err in ((True, wrong), (False, 1 - wrong)):
                key = (round(float(err), 12), f, cut, not above)
                if best is None or key < best:
                    best = key
    return (best[0], best[1], best[2], not best[3]) if best else (0.5, -1, 0.0, True)


def adaptive(df: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 50, rate: float = 1.0, bins: int = 64,
             cuts: list[list[float]] | None = None) -> AdaptiveModel:
    """Fit ``rounds`` stumps; ``cuts`` gives the cut values of each feature, else they are quantiles."""
    features = list(features)
    rows = persist(df.dropna(subset=[label, *features]).select(F.col(label).cast("int").alias(label), *[F.col(f).cast("double").alias(f) for f in features]))
    cuts = [sorted(c) for c in (cuts if cuts is not None else hist_cuts(rows, features, bins))]
    bin_of = [_bin(f, c) for f, c in zip(features, cuts)]
    long = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), b.alias("b")) for i, b in enumerate(bin_of)]))
    model = AdaptiveModel([])
    for _ in range(rounds):
        weight = F.lit(1.0)
        for s in model.stumps:
            # right rows keep their weight, wrong ones are raised by the vote
            weight = weight * F.when(s.says() * (2 * F.col(label) - 1) < 0, math.exp(s.vote)).otherwise(1.0)
        got = rows.select(F.col(label).alias("y"), weight.alias("w"), long).groupBy("f", "b").agg(
            F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("w0"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("w1")).collect()
        err, f, cut, above = _best({(r.f, r.b): (r.w0, r.w1) for r in got}, cuts)
        if f < 0 or err >= 0.5:
            break
        if err <= 0:
            model.stumps = [Stump(features[f], cut, above, 1.0)]
            break
        model.stumps.append(Stump(features[f], cut, above, rate * math.log((1 - err) / err)))
    rows.unpersist()
    return model


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cuts below a value."""
    if not cuts:
        return F.lit(0)
    below = F.array(*[F.lit(float(x)) for x in cuts])
    return F.size(F.filter(below, lambda x: x < F.col(feature).cast("double")))
