"""Parameter search that learns from its trials, a batch at a time.

The first batch is drawn at random from the space. Each later round splits the
trials so far into the good (the ``good`` share of best scores, at least two)
and the rest, fits a density of every parameter to both, draws ``draws``
points from the good density for each place of the batch and keeps the point
whose ratio of good to bad density is highest (Bergstra et al., 2011). A
choice's density is its counts, one added for every option; a quantised range
has a normal kernel on each trial, as wide as the larger gap to its neighbours,
and one wide kernel over the range. The whole batch is scored together, so
that candidates share their scans.

Folds stop trials early: after each fold a trial whose running mean is below
the median of what earlier trials had there is not scored on the others.

``objective(points, fold)`` gives a score for every point (greater is better)
and may be replaced. Everything is seeded; equal points are tried once.
"""

from __future__ import annotations

import math
import random
import statistics
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from callsheet.operators.tuning import SEED, _draw

Objective = Callable[[list[dict], int], list[float]]


@dataclass
class Trial:
    round: int
    params: dict
    folds: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def score(self) -> float:
        return sum(self.folds) / len(self.folds)


class _Density:
    """Density of one parameter over the given values."""

    def __init__(self, kind: str, arg, values: list):
        self.kind, self.arg = kind, arg
        if kind == "choice":
            self.weight = [1.0 + sum(v == o for v in values) for o in arg]
            return
        lo, hi, _ = arg
        at = sorted(values)
        self.kernels = [((lo + hi) / 2, hi - lo)]
        for i, v in enumerate(at):
            gap = max(v - (at[i - 1] if i else lo), (at[i + 1] if i + 1 < len(at) else hi) - v)
            self.kernels.append((v, min(max(gap, (hi - lo) / min(100, len(at) + 1)), hi - lo)))

    def draw(self, rng: random.Random):
        if self.kind == "choice":
            return rng.choices(self.arg, self.weight)[0]
        lo, hi, q = self.arg
        while True:
            v = rng.gauss(*rng.choice(self.kernels))
            if lo <= v <= hi:
                v = round(v / q) * q
                return int(v) if float(q).is_integer() and float(lo).is_integer() else v

    def log(self, value) -> float:
        if self.kind == "choice":
            return math.log(self.weight[self.arg.index(value)] / sum(self.weight))
        lo, hi, _ = self.arg

        def inside(m, s):
            return 0.5 * (math.erf((hi - m) / s / 2 ** 0.5) - math.erf((lo - m) / s / 2 ** 0.5))
        return math.log(sum(math.exp(-0.5 * ((value - m) / s) ** 2) / s / inside(m, s) for m, s in self.kernels) / len(self.kernels))


@dataclass
class Search:
    """A search of ``space`` (see ``tuning.choice`` and ``tuning.quniform``)."""
    space: Mapping
    objective: Objective
    folds: int = 1
    evals: int = 50
    batch: int = 10
    good: float = 0.25
    draws: int = 24
    seed: int = SEED
    trials: list[Trial] = field(default_factory=list)

    def set_objective(self, objective: Objective) -> None:
        self.objective = objective

    def run(self) -> Trial:
        """All trials; returns the best that no fold stopped (ties: the first)."""
        rng, seen, number = random.Random(self.seed), set(), 0
        while len(self.trials) < self.evals:
            some = []
            for _ in range(min(self.batch, self.evals - len(self.trials))):
                point = self._next(rng, seen)
                if point is None:
                    break
                seen.add(tuple(sorted(point.items(), key=lambda x: x[0])))
                some.append(Trial(number, point))
            if not some:   # the space is used up
                break
            self._score(some)
            self.trials += some
            number += 1
        whole = [t for t in self.trials if not t.stopped]
        return max(whole, key=lambda t: t.score)

    def _next(self, rng: random.Random, seen: set) -> dict | None:
        densities = None
        if self.trials:
            by = sorted(self.trials, key=lambda t: (t.stopped, -t.score))   # a stopped trial's score is of the first folds only
            n = max(2, math.ceil(self.good * len(by)))
            densities = {k: [_Density(kind, arg, [t.params[k] for t in part]) for part in (by[:n], by[n:])] for k, (kind, arg) in self.space.items()}
        for _ in range(20):
            if densities is None:
                points = [_draw(self.space, rng)]
            else:
                points = [{k: d[0].draw(rng) for k, d in densities.items()} for _ in range(self.draws)]
            new = [p for p in points if tuple(sorted(p.items(), key=lambda x: x[0])) not in seen]
            if new:
                return new[0] if densities is None else max(new, key=lambda p: sum(d[0].log(p[k]) - d[1].log(p[k]) for k, d in densities.items()))
        return None

    def _score(self, some: list[Trial]) -> None:
        for fold in range(self.folds):
            alive = [t for t in some if not t.stopped]
            for t, s in zip(alive, self.objective([t.params for t in alive], fold)):
                t.folds.append(float(s))
            past = [sum(t.folds[:fold + 1]) / (fold + 1) for t in self.trials if len(t.folds) > fold]
            if past and fold + 1 < self.folds:
                bar = statistics.median(past)
                for t in alive:
                    t.stopped = t.score < bar

    def table(self, spark: SparkSession) -> DataFrame:
        """(trial, round, params, score, folds, stopped) of all trials."""
        rows = [(i, t.round, {k: str(v) for k, v in t.params.items()}, t.score, len(t.folds), t.stopped) for i, t in enumerate(self.trials)]
        return spark.createDataFrame(rows, "trial int, round int, params map<string,string>, score double, folds int, stopped boolean")
