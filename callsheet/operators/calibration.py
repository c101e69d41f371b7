"""Calibrated probabilities: exact isotonic regression and cross-fitting.

Isotonic regression (pool adjacent violators): rows of one score are one
weighted point. Spark orders the points by score in ranges; every range pools
its own, and neighbouring ranges are then pooled together, ``FAN`` at a time,
until one run of blocks is left. Pooling parts first and their blocks after
gives the same blocks as pooling all points at once. A block's value is the
share of its positives, so with n rows there are at most of the order of
n^(2/3) blocks; they are the model. Between two blocks the value is interpolated,
outside it is that of the end block.

Cross-fitting: a base model is fitted without each fold and calibrated on that
fold; the probability is the mean over the folds' pairs.

Points without score or label take no part; an empty fit gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN = 16
_BLOCK = "part int, lo double, hi double, n double, pos double"


def pool(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: blocks of strictly rising pos / n."""
    out: list[list[float]] = []
    for a, b, m, p in zip(lo.tolist(), hi.tolist(), n.tolist(), pos.tolist()):
        out.append([a, b, m, p])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, b, m, p = out.pop()
            out[-1] = [out[-1][0], b, out[-1][2] + m, out[-1][3] + p]
    return tuple(np.array(c) for c in zip(*out)) if out else tuple(np.empty(0) for _ in range(4))


def _pool_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools what comes in order; the blocks of a part are kept, not its points."""
    now, kept = None, tuple(np.empty(0) for _ in range(4))
    names = ["part", "lo", "hi", "n", "pos"]
    for batch in batches:
        part = batch.column("part").to_numpy()
        cols = [batch.column(c).to_numpy() for c in names[1:]]
        for k in np.unique(part).tolist():
            if k != now:
                if len(kept[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept[0]), now, np.int32)), *map(pa.array, kept)], names)
                now, kept = k, tuple(np.empty(0) for _ in range(4))
            kept = pool(*(np.concatenate((a, c[part == k])) for a, c in zip(kept, cols)))
    if len(kept[0]):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept[0]), now, np.int32)), *map(pa.array, kept)], names)


@dataclass
class Isotonic:
    lo: np.ndarray
    hi: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.lo):
            return np.full(len(x), np.nan)
        # every block is flat between its lowest and highest score
        at = np.empty(2 * len(self.lo))
        at[::2], at[1::2] = self.lo, self.hi
        return np.interp(x, at, np.repeat(self.value, 2))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(i), float(a), float(b), float(v)) for i, (a, b, v) in enumerate(zip(self.lo, self.hi, self.value))],
                                     "block int, lo double, hi double, value double")

    def transform(self, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
        names = schema.names

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(score).cast(pa.float64()).to_numpy(zero_copy_only=False)
                v = self(x)
                cols = {**dict(zip(batch.schema.names, batch.columns)), out: pa.array(v, pa.float64(), mask=np.isnan(v))}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)
        return df.mapInArrow(apply, schema)


def isotonic(df: DataFrame, score: str, label: str = "label", parts: int | None = None) -> Isotonic:
    """Fit on rows of a score and a 0/1 label."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = F.col(score).cast("double")
    points = df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(s.alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).cast("double").alias("pos"))
    got = points.repartitionByRange(parts, "lo").sortWithinPartitions("lo").select(F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "n", "pos") \
        .mapInArrow(_pool_parts, _BLOCK)
    left = parts
    while left > 1:   # neighbouring runs of blocks, in order
        got = got.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).repartition("part").sortWithinPartitions("part", "lo").mapInArrow(_pool_parts, _BLOCK)
        left = -(-left // FAN)
    rows = sorted(got.collect(), key=lambda r: r.lo)
    return Isotonic(*(np.array([r[c] for r in rows]) for c in ("lo", "hi")), np.array([r.pos / r.n for r in rows]))


def cross_fitted(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], score: str, label: str = "label",
                 fold: str = "fold", folds: int = 5, out: str = "probability") -> DataFrame:
    """``test`` with the mean of the folds' calibrated scores. ``fit(rows)``
    gives a function that adds the column ``score`` to a frame."""
    names = []
    for k in range(folds):
        add = fit(train.where(F.col(fold) != k))
        curve = isotonic(add(train.where(F.col(fold) == k)), score, label)
        names.append(f"_p{k}")
        test = curve.transform(add(test), score, names[-1]).drop(score)
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return test.withColumn(out, total / len(names)).drop(*names)
