"""Mistake-driven linear classifiers (perceptron, passive-aggressive) trained
by iterative parameter mixing (McDonald, Hall and Mann, 2010).

Rows are dealt to ``parts`` parts by a seeded hash of their id and ordered by
it. In an epoch every part runs the sequential algorithm over its rows from
the shared weights; the new shared weights are the parts' weights averaged by
their row counts (``parts`` x features numbers reach the driver). With one
part this is the sequential algorithm. The result depends on ids, seed and
``parts``, not on Spark's partitions or the order of tasks.

Updates for y = +1 / -1 and f = w x + b:

* perceptron: if y f <= 0, add rate * y * x; after each row the penalty shrinks
  the weights (l2: by the factor 1 - rate * alpha; l1: towards 0 by rate * alpha);
* passive-aggressive: with loss = max(0, 1 - y f), add tau * y * x with
  tau = min(C, loss / |x|^2) ("hinge") or loss / (|x|^2 + 1 / (2 C)) ("squared_hinge").

An epoch ends the training if no part made an update, or if the mean loss has
not fallen by ``tol`` for ``patience`` epochs. Rows without a label or with a
missing feature take no part and get no prediction; of an empty table or one
of a single class the weights stay 0 or follow that class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsheet.session import persist

SEED = 6932
#: rows of a part that a task holds and runs over at once
STEP = 100_000


@dataclass
class OnlineParams:
    kind: str = "perceptron"          # or "passive_aggressive"
    loss: str = "hinge"               # or "squared_hinge"
    c: float = 1.0
    rate: float = 1.0
    penalty: str | None = None        # None, "l2", "l1"
    alpha: float = 0.0001
    epochs: int = 20
    tol: float = 1e-3
    patience: int = 5
    parts: int = 8
    seed: int = SEED


def run_part(x: np.ndarray, y: np.ndarray, w: np.ndarray, p: OnlineParams) -> tuple[np.ndarray, float, int]:
    """One pass of the sequential algorithm; the last weight is the intercept.
    Returns (weights, summed loss, updates)."""
    w, total, updates = w.copy(), 0.0, 0
    norm = (x ** 2).sum(1)
    for xi, yi, n in zip(x, y, norm):
        f = yi * (float(xi @ w[:-1]) + w[-1])
        if p.kind == "perceptron":
            total += max(0.0, -f)
            step = p.rate if f <= 0 else 0.0
        else:
            loss = max(0.0, 1.0 - f)
            total += loss if p.loss == "hinge" else loss * loss
            step = 0.0 if not loss or (not n and p.loss == "hinge") else min(p.c, loss / n) if p.loss == "hinge" else loss / (n + 1 / (2 * p.c))
        if step:
            w[:-1] += step * yi * xi
            w[-1] += step * yi
            updates += 1
        if p.kind == "perceptron" and p.penalty == "l2":
            w[:-1] *= 1 - p.rate * p.alpha
        elif p.kind == "perceptron" and p.penalty == "l1":
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - p.rate * p.alpha, 0.0)
    return w, total, updates


@dataclass
class OnlineModel:
    features: list[str]
    weights: np.ndarray
    epochs: int

    def margin(self) -> Column:
        """w x + b as a column; null if a feature is missing."""
        terms = [F.col(f).cast("double") * float(w) for f, w in zip(self.features, self.weights)]
        total = F.lit(float(self.weights[-1]))
        for t in terms:
            total = total + t
        return total

    def transform(self, df: DataFrame, prediction: str = "prediction", margin: str = "margin") -> DataFrame:
        return df.withColumn(margin, self.margin()).withColumn(prediction, (F.col(margin) > 0).cast("int"))


def _epoch(weights: np.ndarray, params: OnlineParams, state: dict[int, tuple]):
    """An epoch's next step; ``state`` has (part, weights, rows, loss, updates) of the parts that are under way."""
    under_way = {k: (np.array(r[1]), *r[2:]) for k, r in state.items()}

    def epoch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, n, loss, updates, out = None, weights, 0, 0.0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            y = batch.column("y").to_numpy()
            x = batch.column("x")
            x = x.values.to_numpy()[x.offsets[0].as_py():x.offsets[-1].as_py()].reshape(len(y), -1)
            for k in np.unique(part).tolist():   # sorted: a part goes on in the next batch or is over
                if k != now:
                    if now is not None:
                        out.append((now, w.tolist(), n, loss, updates))
                    now, (w, n, loss, updates) = k, under_way.get(k, (weights, 0, 0.0, 0))
                at = part == k
                w, more, made = run_part(x[at], y[at], w, params)
                n, loss, updates = n + int(at.sum()), loss + more, updates + made
        if now is not None:
            out.append((now, w.tolist(), n, loss, updates))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int64()))],
                                         ["part", "w", "n", "loss", "updates"])
    return epoch


def train(df: DataFrame, id_col: str, features: Sequence[str], label: str = "label", params: OnlineParams | None = None) -> OnlineModel:
    """Fit on ``df``; ``label`` is 0/1."""
    params = params or OnlineParams()
    h = F.xxhash64(F.col(id_col), F.lit(params.seed))
    whole = df.dropna(subset=[label, *features])
    rows = whole.select(F.pmod(h, F.lit(params.parts)).cast("int").alias("part"), h.alias("_h"), F.col(id_col).alias("_id"), (F.col(label) * 2 - 1).cast("double").alias("y"),
                        F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    # a part goes in steps by ascending hash, so no task holds more than a step of it
    steps = max(1, -(-whole.count() // (params.parts * STEP)))
    step = (F.shiftright("_h", 32) + F.lit(1 << 31)) * steps
    rows = rows.withColumn("step", F.shiftright(step, 32).cast("int"))
    dealt = rows.repartition(params.parts * steps, "step", "part").sortWithinPartitions("step", "part", "_h", "_id").select("step", "part", "y", "x")
    dealt = persist(dealt)
    w, best, waited, done = np.zeros(len(features) + 1), np.inf, 0, 0
    for done in range(1, params.epochs + 1):
        state: dict[int, tuple] = {}
        for s in range(steps):
            some = dealt.where(F.col("step") == s).drop("step") if steps > 1 else dealt.drop("step")
            state |= {r.part: r for r in some.mapInArrow(_epoch(w, params, state), "part int, w array<double>, n long, loss double, updates long").collect()}
        got = [state[k] for k in sorted(state)]
        n = sum(r.n for r in got)
        if not n:
            break
        w = sum(np.array(r.w) * (r.n / n) for r in got)
        loss = sum(r.loss for r in got) / n
        waited = 0 if loss < best - params.tol else waited + 1
        best = min(best, loss)
        if not any(r.updates for r in got) or waited >= params.patience:
            break
    dealt.unpersist()
    return OnlineModel(list(features), w, done)
