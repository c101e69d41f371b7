"""Second-order boosted trees for a 0/1 label, grown level by level.

Every feature is cut into bins once; a row is then one byte a feature, its
margin, its label and a hash. A level is one pass and one shuffle: tasks sum
gradients and hessians by (node, feature, bin) for the rows that they hold, the
sums of a node meet in one task, and their running sums per (node, feature)
give the gain of every cut; only the best cut of each node reaches the driver.
Nodes of less than two ``child_weight`` are not asked: they have no cut. Sums are integers
(units of 2^-30), so they and the trees do not depend on the order of tasks.

With G, H the sums of a node, T(G) = sign(G) max(|G| - alpha, 0) and
score = T(G)^2 / (H + lam), a cut gains score(left) + score(right) -
score(node). It needs a positive gain and ``child_weight`` of H on both sides.
Once a tree is grown, cuts that gain less than ``gamma`` are taken back from
the leaves up. A leaf adds -rate * T(G) / (H + lam). Rows and columns are
sampled per tree by hash. A missing value goes to the side where it gains more
(left on a tie). Ties of the gain go to the first feature, then the lowest cut.

Rows without a label take no part in a fit; every row gets a prediction.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.session import ensure_checkpoint_dir, persist

UNIT = float(1 << 30)
CHECKPOINT_EVERY = 10
#: cells of a task's table of sums: a level of more nodes takes several passes
CELLS = 1 << 22


@dataclass
class BoostParams:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    child_weight: float = 1.0
    bins: int = 64
    seed: int = 6932


@dataclass
class Tree:
    """Nodes in the order of their making: feature (-1: leaf), last bin that goes
    left, whether missing goes left, children, gain, leaf value."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float, values: tuple[float, float]) -> None:
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, at, missing_left, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v in values:
            for name, x in (("feature", -1), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1), ("gain", 0.0), ("value", v)):
                getattr(self, name).append(x)

    def prune(self, gamma: float) -> None:
        """Take back cuts of two leaves that gain less than ``gamma``, from the last made on."""
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and self.gain[node] < gamma and self.feature[self.left[node]] < 0 and self.feature[self.right[node]] < 0:
                self.feature[node] = -1

    def leaves(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Leaf of every row of a bin matrix; ``missing`` is each feature's bin of missing values."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        missing_left = np.array(self.missing_left)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            if not len(rows):
                return node
            at, x = node[rows], bins[rows, f]
            goes_left = np.where(x == missing[f], missing_left[at], x <= cut[at])
            node[rows] = np.where(goes_left, left[at], right[at])


def hist_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Cut values of every feature: approximate quantiles, within a quarter of a bin."""
    probs = [i / bins for i in range(1, bins)]
    got = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), probs, 0.25 / bins)
    return [sorted(set(c)) for c in got]


@dataclass
class BoostedModel:
    features: list[str]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin of every value: the number of cuts below it; missing values have the last."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, (x, cuts) in enumerate(zip(columns, self.cuts)):
            out[:, j] = np.where(np.isnan(x), len(cuts) + 1, np.searchsorted(np.array(cuts), x, "left"))
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaves(bins, self.missing)]
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        """``df`` with the probability of class 1 and the class at 0.5."""
        keep = [f for f in df.schema.fields if f.name not in (prediction, probability)]
        schema = T.StructType([*keep, T.StructField(prediction, T.IntegerType()), T.StructField(probability, T.DoubleType())])
        names = schema.names

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = 1 / (1 + np.exp(-self.margins(self.binned(_columns(batch, self.features)))))
                cols = {**dict(zip(batch.schema.names, batch.columns)), prediction: pa.array((p >= 0.5).astype(np.int32)), probability: pa.array(p)}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)
        return df.mapInArrow(score, schema)

    def importance(self, spark) -> DataFrame:
        """(feature, gain, cuts): the total gain and number of each feature's cuts."""
        gain, n = [0.0] * len(self.features), [0] * len(self.features)
        for t in self.trees:
            for f, g, node in zip(t.feature, t.gain, range(len(t.feature))):
                if f >= 0:
                    gain[f], n[f] = gain[f] + g, n[f] + 1
        return spark.createDataFrame(list(zip(self.features, gain, n)), "feature string, gain double, cuts int")


def _columns(batch: pa.RecordBatch, features: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for f in features]


def _chosen(key: str, share: float) -> bool:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") < share * 2.0 ** 64


def tree_columns(p: int, params: BoostParams, tree: int) -> list[int]:
    """Columns of a tree: the round(colsample * p) of smallest hash, at least one."""
    by = sorted(range(p), key=lambda j: hashlib.blake2b(f"{params.seed}:{tree}:{j}".encode(), digest_size=8).digest())
    return sorted(by[:max(1, round(params.colsample * p))])


def in_sample(h: np.ndarray, params: BoostParams, tree: int) -> np.ndarray:
    """Rows of a tree, by a hash of the row's hash and the tree."""
    if params.subsample >= 1:
        return np.ones(len(h), bool)
    x = h.view(np.uint64) ^ np.uint64(int.from_bytes(hashlib.blake2b(f"{params.seed}:{tree}".encode(), digest_size=8).digest(), "little"))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(params.subsample * 2.0 ** 64), 2 ** 64 - 1))


_STATE = "h long, y double, bins binary, margin double"


def _state(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    col = batch.column("bins")
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offs[0]:offs[-1]].reshape(-1, p)
    return batch.column("h").to_numpy(), batch.column("y").to_numpy(), raw, batch.column("margin").to_numpy()


def _start(model: BoostedModel):
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(_columns(batch, model.features))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), _binary(bins), pa.array(np.full(len(bins), model.base))],
                                             ["h", "y", "bins", "margin"])
    return start


def _binary(rows: np.ndarray) -> pa.Array:
    offs = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def _histogram(tree: Tree, number: int, open_: list[int], columns: list[int], params: BoostParams, missing: np.ndarray):
    """Sums of gradients, hessians and rows by (node, feature, bin) of a task's rows."""
    width = int(missing.max()) + 1
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    cells = len(columns) * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(open_) * cells
        g, h = np.zeros(size, np.int64), np.zeros(size, np.int64)
        usual, all_g, all_h = None, np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, y, bins, margin = _state(batch, len(missing))
            node = place[tree.leaves(bins, missing)]
            use = np.flatnonzero((node >= 0) & in_sample(row, params, number))
            p = 1 / (1 + np.exp(-margin[use]))
            gi, hi = np.rint((p - y[use]) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)
            own, node = bins[use][:, columns], node[use]
            if usual is None:   # the bin that a task's first rows have most often: its sums are what the others leave
                usual = np.array([np.bincount(bins[:, f], minlength=width).argmax() for f in columns])
            np.add.at(all_g, node, gi)
            np.add.at(all_h, node, hi)
            r, c = np.nonzero(own != usual)
            at = node[r] * cells + c * width + own[r, c]
            np.add.at(g, at, gi[r])
            np.add.at(h, at, hi[r])
        if usual is not None:
            for x, total in ((g, all_g), (h, all_h)):
                by = x.reshape(len(open_), len(columns), width)
                by[:, np.arange(len(columns)), usual] = total[:, None] - by.sum(2)
        there = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_arrays([pa.array((there // (len(columns) * width)).astype(np.int32)), pa.array(np.array(columns, np.int32)[there // width % len(columns)]),
                                          pa.array((there % width).astype(np.int32)), pa.array(g[there]), pa.array(h[there])], ["node", "feature", "bin", "g", "h"])
    return sums


_CELL = "node int, feature int, bin int, g long, h long"
_CUT = "node int, gain double, nf int, nb int, left boolean, gl long, hl long, gr long, hr long"


def _best_cuts(cells: DataFrame, missing: np.ndarray, params: BoostParams) -> DataFrame:
    """(node, gain, nf, nb, left, gl, hl, gr, hr): every node's best cut, the
    feature and bin as negatives. ``cells`` are the tasks' sums; those of a
    node meet in one task, so a level is one shuffle."""

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        t = np.maximum(np.abs(g) / UNIT - params.alpha, 0.0)
        return t * t / (h / UNIT + params.lam)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        node, feature, at, g, h = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("node", "feature", "bin", "g", "h"))
        by = np.lexsort((at, feature, node))
        node, feature, at, g, h = (x[by] for x in (node, feature, at, g, h))
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (feature[1:] != feature[:-1]) | (node[1:] != node[:-1]))))
        g, h = np.add.reduceat(g, new), np.add.reduceat(h, new)
        node, feature, at = node[new], feature[new], at[new]
        heads = np.flatnonzero(np.concatenate(([True], (feature[1:] != feature[:-1]) | (node[1:] != node[:-1]))))
        counts = np.diff(np.append(heads, len(node)))
        miss = at == missing[feature]
        sums = []
        for x in (g, h):
            upto = np.cumsum(np.where(miss, 0, x))
            sums += [np.repeat(np.add.reduceat(x, heads), counts), np.repeat(np.add.reduceat(np.where(miss, x, 0), heads), counts),
                     upto - np.repeat(upto[heads] - np.where(miss, 0, x)[heads], counts)]
        ga, gm, gp, ha, hm, hp = sums
        ways = []
        for left in (False, True):
            gl, hl = gp + gm * left, hp + hm * left
            gr, hr = ga - gl, ha - hl
            gain = score(gl, hl) + score(gr, hr) - score(ga, ha)
            gain = np.floor(np.where(np.isfinite(gain), gain, 0.0) * 1e9 + 0.5) / 1e9
            ok = np.flatnonzero(~miss & (hl >= params.child_weight * UNIT) & (hr >= params.child_weight * UNIT) & (hl > 0) & (hr > 0) & (gain > 0))
            ways.append([x[ok] for x in (node, gain, -feature, -at, np.full(len(node), left), gl, hl, gr, hr)])
        cols = [np.concatenate(x) for x in zip(*ways)]
        by = np.lexsort(tuple(cols[4::-1]))   # the greatest of a node is its last
        last = by[np.flatnonzero(np.concatenate((np.diff(cols[0][by]) != 0, [True])))] if len(by) else by
        names = ["node", "gain", "nf", "nb", "left", "gl", "hl", "gr", "hr"]
        types = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c[last], t) for c, t in zip(cols, types)], names)
    return cells.repartition("node").mapInArrow(best, _CUT)


def _tasks(state: DataFrame) -> int:
    """Tasks of a level: a few a core, however many rows."""
    return 4 * state.sparkSession.sparkContext.defaultParallelism


def _weight(g: int, h: int, params: BoostParams) -> float:
    t = math.copysign(max(abs(g / UNIT) - params.alpha, 0.0), g)
    return -params.rate * t / (h / UNIT + params.lam)


def _grown(state: DataFrame, number: int, params: BoostParams, missing: np.ndarray) -> Tree:
    tree, open_ = Tree(), [0]
    columns = tree_columns(len(missing), params, number)
    first = True
    for _ in range(params.depth):
        step = max(1, CELLS // (len(columns) * (int(missing.max()) + 1)))
        found = []
        for at in range(0, len(open_), step):
            some = open_[at:at + step]
            # few tasks: each hands on a sum of every cell that its rows reach
            cells = state.coalesce(_tasks(state)).mapInArrow(_histogram(tree, number, some, columns, params, missing), _CELL)
            found += [(some[r.node], r) for r in _best_cuts(cells, missing, params).collect()]
        made = []
        for node, r in sorted(found, key=lambda x: x[0]):
            if first:   # the root's own value, should its cut be taken back
                tree.value[0], first = _weight(r.gl + r.gr, r.hl + r.hr, params), False
            tree.split(node, -r.nf, -r.nb, r.left, r.gain, (_weight(r.gl, r.hl, params), _weight(r.gr, r.hr, params)))
            # a node that cannot give both sides their weight has no cut
            made += [child for child, h in ((tree.left[node], r.hl), (tree.right[node], r.hr)) if h >= 2 * params.child_weight * UNIT]
        open_ = made
        if not open_:
            break
    if first:   # no cut gains anything: one leaf for all rows
        r = state.mapInArrow(_histogram(tree, number, [0], columns[:1], params, missing), _CELL).agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).first()
        tree.value[0] = _weight(r.g or 0, r.h or 0, params)
    tree.prune(params.gamma)
    return tree


def boost(df: DataFrame, id_col: str, features: Sequence[str], label: str = "label", params: BoostParams | None = None,
          cuts: list[list[float]] | None = None) -> BoostedModel:
    """Fit on ``df``; ``cuts`` gives the cut values of each feature (at most
    250), else they are quantiles. The first margin is the log-odds of the label."""
    params = params or BoostParams()
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(label).isNotNull()).select(F.xxhash64(F.col(id_col), F.lit(params.seed)).alias("h"), F.col(label).cast("double").alias("y"),
                                                    *[F.col(f).cast("double").alias(f) for f in features])
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).first()
    if not r.n:
        return BoostedModel(list(features), [[] for _ in features], 0.0, [])
    cuts = cuts if cuts is not None else hist_cuts(rows, features, params.bins)
    if max(map(len, cuts), default=0) > 250:
        raise ValueError("a feature has at most 250 cuts")
    share = min(max(r.s / r.n, 1e-9), 1 - 1e-9)
    model = BoostedModel(list(features), [sorted(c) for c in cuts], math.log(share / (1 - share)), [])
    missing = model.missing
    state = persist(rows.mapInArrow(_start(model), _STATE))
    for number in range(params.rounds):
        tree = _grown(state, number, params, missing)
        model.trees.append(tree)
        if number + 1 == params.rounds:
            break

        def add(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            value = np.array(tree.value)
            for batch in batches:
                _, _, bins, margin = _state(batch, len(missing))
                more = margin + value[tree.leaves(bins, missing)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more)], batch.schema.names)
        after = state.mapInArrow(add, _STATE)
        after = after.checkpoint() if (number + 1) % CHECKPOINT_EVERY == 0 else persist(after)
        after.count()
        state.unpersist()
        state = after
    state.unpersist()
    return model
