"""Truncated SVD of wide sparse rows by random range finding (Halko,
Martinsson and Tropp, 2011), without a p x p matrix.

A pass over the rows multiplies X'X by a p x l basis: tasks hand on, for the
features that they saw, the sums of x (x B), which Spark adds up by feature.
``passes`` of them, each made orthonormal, turn a seeded random basis
towards the largest singular directions; one more pass gives the l x l Gramian
of X B, whose eigenvectors turn B into the right singular vectors (l = k +
``OVERSAMPLE``, at most p). The driver and the tasks hold p x l numbers.

Exact up to rounding if l = p; else the error of the j-th value falls with
(s(l+1) / s(j)) to the power 2 * passes. Signs: the largest loading is
positive. Rows without a vector take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLE, PASSES, SEED = 10, 4, 6932
#: features whose sums a task holds before it hands them on
HELD = 50_000


def _entries(df: DataFrame, features: str) -> DataFrame:
    """(at, v): the non-zero places and values of every row. Arrow hands a
    vector over as (type, size, indices, values): a sparse one is never filled out."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, _, indices, values = batch.column(0).flatten()
            sparse = pc.equal(kind, 0)
            yield pa.RecordBatch.from_arrays([indices.filter(sparse).cast(pa.list_(pa.int32())), values.filter(sparse).cast(pa.list_(pa.float64()))], ["at", "v"])
            dense = values.filter(pc.invert(sparse))
            if len(dense):
                x, offs = dense.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(dense).to_numpy())))
                keep = x != 0
                place = np.arange(len(x)) - np.repeat(offs[:-1], np.diff(offs))
                cuts = pa.array(np.concatenate(([0], np.cumsum(keep)))[offs].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(place[keep].astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(x[keep]))], ["at", "v"])
    return df.where(F.col(features).isNotNull()).select(features).mapInArrow(entries, "at array<int>, v array<double>")


def _times(basis: np.ndarray):
    """Sums of x (x B) by feature."""
    width = basis.shape[1]

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        held = np.zeros((1024, width))

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(sums, np.int32, len(sums))
            rows = held[:len(sums)].ravel()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(keys))), pa.array(rows)], ["f", "c", "s"])
        for batch in batches:
            at, v = batch.column("at"), batch.column("v")
            offs = at.offsets.to_numpy()
            places, values = at.values.to_numpy()[offs[0]:offs[-1]], v.values.to_numpy()[v.offsets[0].as_py():v.offsets[-1].as_py()]
            if not len(places):
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            z = np.zeros((batch.num_rows, width))
            np.add.at(z, row, basis[places] * values[:, None])
            own, where = np.unique(places, return_inverse=True)
            part = np.zeros((len(own), width))
            np.add.at(part, where, z[row] * values[:, None])
            slot = np.array([sums.setdefault(int(f), len(sums)) for f in own])
            while len(sums) > len(held):
                held = np.concatenate((held, np.zeros_like(held)))
            held[slot] += part
            if len(sums) > HELD:
                yield flush()
                sums.clear()
                held = np.zeros((1024, width))
        if sums:
            yield flush()
    return times


def _gram(basis: np.ndarray):
    """Sum of (x B)'(x B)."""
    width = basis.shape[1]

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            at, v = batch.column("at"), batch.column("v")
            offs = at.offsets.to_numpy()
            places, values = at.values.to_numpy()[offs[0]:offs[-1]], v.values.to_numpy()[v.offsets[0].as_py():v.offsets[-1].as_py()]
            z = np.zeros((batch.num_rows, width))
            np.add.at(z, np.repeat(np.arange(batch.num_rows), np.diff(offs)), basis[places] * values[:, None])
            total += z.T @ z
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["f", "c", "s"])
    return gram


def _summed(rows: DataFrame, fn, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    got = rows.mapInArrow(fn, "f int, c int, s double").groupBy("f", "c").agg(F.sum("s").alias("s")).toArrow()
    out[got.column("f").to_numpy(), got.column("c").to_numpy()] = got.column("s").to_numpy()
    return out


def wide_svd(df: DataFrame, features: str, k: int, width: int, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors width x k) of the rows of ``features``."""
    rows = _entries(df, features).persist()
    n = min(width, k + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, n)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_summed(rows, _times(basis), (width, n)))[0]
    values, turn = np.linalg.eigh(_summed(rows, _gram(basis), (n, n)))
    rows.unpersist()
    order = np.argsort(-values)[:k]
    vectors = basis @ turn[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return np.sqrt(np.maximum(values[order], 0.0)), vectors * np.where(signs == 0, 1.0, signs)


def wide_variance(df: DataFrame, features: str, k: int, width: int, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """(component, singular_value, ratio, cumulative): shares of the rows' sum of squares."""
    values, _ = wide_svd(df, features, k, width, passes, seed)
    norm = df.where(F.col(features).isNotNull()).agg(Summarizer.normL2(F.col(features)).alias("n")).first()
    total = float((norm["n"].toArray() ** 2).sum()) if norm and norm["n"] is not None else 0.0
    share = values ** 2 / total if total else np.zeros(len(values))
    return df.sparkSession.createDataFrame([(i + 1, float(s), float(r), float(c)) for i, (s, r, c) in enumerate(zip(values, share, np.cumsum(share)))],
                                           "component int, singular_value double, ratio double, cumulative double")
