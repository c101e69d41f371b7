"""Ward linkage with merge heights over mergeable clustering features.

A clustering feature is a count and a mean. Every slice of the rows keeps at
most ``2 * limit`` of them: a row joins its nearest feature if that costs no
more than the dearest merge made so far, else it is a new one, and a full
slice merges its features by Ward's rule down to ``limit``. Slices merge the
same way, sixteen at a time, until one set of at most ``limit`` is left, on
which weighted Ward linkage runs (the driver holds ``limit`` means, whatever
the input). With at most ``limit`` distinct rows nothing is merged before, so
the tree is that of plain Ward linkage on the rows.

The height of a merge is sqrt(2 n m / (n + m)) times the distance of the two
means. Rows are dealt to slices by a hash of their id and ordered by it, so the
result depends neither on the partitions nor on the order of tasks. Rows
without a vector take no part and have no cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 6932
LIMIT, SLICES, FAN = 512, 64, 16
_CF = "slice int, n long, mean array<double>, dearest double"


def linkage(n: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of weighted means by Ward's rule, by height; a and b
    are features of the two sides. Found by chains of nearest neighbours."""
    n, mean = n.astype(float), mean.astype(float)
    alive = np.ones(len(n), bool)
    chain: list[int] = []
    merges = []
    for _ in range(len(n) - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            cost = n * n[a] / (n + n[a]) * ((mean - mean[a]) ** 2).sum(1)
            cost[~alive] = cost[a] = np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        lo, hi = min(a, b), max(a, b)
        merges.append((lo, hi, float(np.sqrt(2 * cost[b]))))
        mean[lo] = (n[lo] * mean[lo] + n[hi] * mean[hi]) / (n[lo] + n[hi])
        n[lo] += n[hi]
        alive[hi] = False
    return sorted(merges, key=lambda x: x[2])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _groups(m: int, merges: list[tuple[int, int, float]]) -> np.ndarray:
    """Smallest member of every feature's group once the merges are made."""
    parent = list(range(m))
    for a, b, _ in merges:
        a, b = sorted((_root(parent, a), _root(parent, b)))
        parent[b] = a
    return np.array([_root(parent, i) for i in range(m)], dtype=int)


def _compressed(n: np.ndarray, mean: np.ndarray, dearest: float, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """At most ``limit`` features, and the height of the dearest merge so far."""
    if len(n) <= limit:
        return n, mean, dearest
    merges = linkage(n, mean)[:len(n) - limit]
    of = _groups(len(n), merges)
    heads, group = np.unique(of, return_inverse=True)
    total = np.bincount(group, n)
    sums = np.stack([np.bincount(group, n * c) for c in mean.T], axis=1)
    return total, sums / total[:, None], max(dearest, merges[-1][2])


def _absorb(rows: np.ndarray, weight: np.ndarray, n: np.ndarray, mean: np.ndarray, dearest: float) -> tuple[np.ndarray, np.ndarray]:
    """Features once rows joined theirs; rows that are too far are features of their own."""
    if len(n):
        d2 = ((rows ** 2).sum(1)[:, None] - 2 * rows @ mean.T + (mean ** 2).sum(1)[None]).clip(0)
        near = d2.argmin(1)
        d2 = ((rows - mean[near]) ** 2).sum(1)
        joins = np.sqrt(2 * weight * n[near] / (weight + n[near]) * d2) <= dearest
        more = np.bincount(near[joins], weight[joins], minlength=len(n))
        sums = np.stack([np.bincount(near[joins], weight[joins] * c, minlength=len(n)) for c in rows[joins].T], axis=1) if joins.any() else 0.0
        mean = (mean * n[:, None] + sums) / (n + more)[:, None] if joins.any() else mean
        n, rows, weight = n + more, rows[~joins], weight[~joins]
    if len(rows):   # equal rows are one feature
        own, group = np.unique(rows, axis=0, return_inverse=True)
        n, mean = np.concatenate((n, np.bincount(group.ravel(), weight))), np.concatenate((mean, own)) if len(mean) else own
    return n, mean


def _feature_rows(limit: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, mean, dearest = None, np.empty(0), np.empty((0, 0)), 0.0

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                a, b, h = _compressed(n, mean, dearest, limit)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), now), pa.int32()), pa.array(a.astype(np.int64)),
                                                  pa.array(list(b), pa.list_(pa.float64())), pa.array(np.full(len(a), h))], ["slice", "n", "mean", "dearest"])
        for batch in batches:
            if not batch.num_rows:
                continue
            slices = batch.column("slice").to_numpy()
            x = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
            for s in np.unique(slices).tolist():   # sorted, so a slice goes on in the next batch or is over
                if s != now:
                    yield from done()
                    now, n, mean, dearest = s, np.empty(0), np.empty((0, x.shape[1])), 0.0
                rows = x[slices == s]
                for at in range(0, len(rows), limit):
                    some = rows[at:at + limit]
                    n, mean = _absorb(some, np.ones(len(some)), n, mean, dearest)
                    if len(n) > 2 * limit:
                        n, mean, dearest = _compressed(n, mean, dearest, limit)
        yield from done()
    return reduce


@dataclass
class WardTree:
    """Features and the merges between them, by height."""
    n: np.ndarray
    mean: np.ndarray
    merges: list[tuple[int, int, float]]

    def cut(self, height: float | None = None, k: int | None = None) -> np.ndarray:
        """Cluster of every feature: merges up to ``height``, or until ``k`` are
        left; numbered by size, then by mean."""
        made = [m for m in self.merges if m[2] <= height] if height is not None else self.merges[:max(len(self.n) - (k or 1), 0)]
        heads, group = np.unique(_groups(len(self.n), made), return_inverse=True)
        size = np.bincount(group, self.n)
        centre = np.stack([np.bincount(group, self.n * c) for c in self.mean.T], axis=1) / size[:, None]
        order = sorted(range(len(heads)), key=lambda g: (-size[g], tuple(centre[g])))
        return np.argsort(order)[group]

    def table(self, spark, top: int | None = None) -> DataFrame:
        """(merge, height, size, gap): the merges from the first, or only the
        ``top`` highest; ``gap`` is how much higher the next one is."""
        size, parent, rows = self.n.astype(float).copy(), list(range(len(self.n))), []
        for i, (a, b, h) in enumerate(self.merges):
            a, b = sorted((_root(parent, a), _root(parent, b)))
            parent[b] = a
            size[a] += size[b]
            after = self.merges[i + 1][2] - h if i + 1 < len(self.merges) else None
            rows.append((i + 1, h, int(size[a]), after))
        return spark.createDataFrame(rows[-top:] if top else rows, "merge int, height double, size long, gap double")

    def assign(self, df: DataFrame, vector: str, cluster: np.ndarray, out: str = "cluster") -> DataFrame:
        """Every row gets the cluster of its nearest feature (ties: the first)."""
        schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.IntegerType())])
        names, mean, base = schema.names, self.mean, (self.mean ** 2).sum(1)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(vector)
                ok = col.is_valid().to_numpy(zero_copy_only=False)
                label = np.zeros(batch.num_rows, np.int32)
                where = np.flatnonzero(ok)
                for at in range(0, len(where), 4096):
                    x = np.stack(col.take(pa.array(where[at:at + 4096])).to_numpy(zero_copy_only=False))
                    label[where[at:at + 4096]] = cluster[(base[None] - 2 * x @ mean.T).argmin(1)]
                cols = dict(zip(batch.schema.names, batch.columns))
                cols[out] = pa.array(label, pa.int32(), mask=~ok)
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)
        return df.mapInArrow(near, schema)


def ward(df: DataFrame, id_col: str, vector: str, limit: int = LIMIT, slices: int = SLICES, seed: int = SEED) -> WardTree:
    """Fit the tree on the rows of ``df``; ``vector`` is an array of doubles."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = df.where(F.col(vector).isNotNull()).select(F.pmod(h, F.lit(slices)).cast("int").alias("slice"), h.alias("_h"), F.col(vector).cast("array<double>").alias("v"))
    got = rows.repartition("slice").sortWithinPartitions("slice", "_h", "v").drop("_h").mapInArrow(_feature_rows(limit), _CF)

    def together(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["slice"], kind="stable")
        mean = np.stack(group["mean"].to_numpy())
        own, at = np.unique(mean, axis=0, return_inverse=True)
        n, mean, h = _compressed(np.bincount(at.ravel(), group["n"].to_numpy(float)), own, float(group["dearest"].max()), limit)
        return pd.DataFrame({"slice": int(group["slice"].iloc[0]) // FAN, "n": n.astype(np.int64), "mean": list(mean), "dearest": h})

    left = slices
    while left > 1:   # sets of at most ``limit`` features, FAN of them to a task
        got = got.groupBy(F.floor(F.col("slice") / FAN)).applyInPandas(together, _CF)
        left = -(-left // FAN)
    final = got.collect()
    if not final:
        return WardTree(np.empty(0), np.empty((0, 0)), [])
    n, mean = np.array([float(r["n"]) for r in final]), np.array([r["mean"] for r in final])
    order = np.lexsort(mean.T[::-1])
    n, mean = n[order], mean[order]
    return WardTree(n, mean, linkage(n, mean))
