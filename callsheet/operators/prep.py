"""Feature preparation: exact stratified split and folds, scaling, mode
imputation, one-hot encoding and the encoding pipeline (fit on train only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions.columns import seeded_hash
from callsheet.session import persist

# Fixed value (the notebooks' single random seed):
SEED = 6932
HASH_BUCKET_DIGITS = 5  # 16**5 = 1,048,576 buckets per class


def rank_within_class(df: DataFrame, label: str, id_col: str, seed: int = SEED,
                      bucket_digits: int = HASH_BUCKET_DIGITS) -> DataFrame:
    """Add ``_rank`` (1-based position of each row inside its class when rows
    are ordered by ``md5(id || seed)``, ties by id) and ``_class_n``.

    Equivalent to ``row_number() OVER (PARTITION BY label ORDER BY md5, id)``
    but never sorts a whole class in one task (a class may hold most rows):
    the hash prefix cuts each class into ~1M buckets; the bucket histogram
    (bounded by classes x buckets, independent of the rows) gives every
    bucket's offset, and rows are ranked only within their bucket. Shuffle
    keys are (label, bucket), so work spreads evenly whatever the skew.
    """
    h = seeded_hash(id_col, seed)
    keyed = (df.withColumn("_h", h)
             .withColumn("_b", F.conv(F.substring("_h", 1, bucket_digits), 16, 10).cast("long")))
    hist = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wcum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(label, "_b",
                          F.coalesce(F.sum("_bn").over(wcum), F.lit(0)).alias("_off"),
                          F.sum("_bn").over(Window.partitionBy(label)).alias("_class_n"))
    win = Window.partitionBy(label, "_b").orderBy("_h", id_col)
    ranked = keyed.join(offsets, [label, "_b"]).withColumn(
        "_rank", F.col("_off") + F.row_number().over(win))
    return ranked.drop("_h", "_b", "_off")


PART_BUCKET_DIGITS = 4  # 16**4 = 65,536 hash buckets per class for rank cuts


def rank_parts(df: DataFrame, label: str, id_col: str, cuts, seed: int = SEED, out: str = "_part",
               bucket_digits: int = PART_BUCKET_DIGITS, apply=None) -> DataFrame:
    """Part index of every row from rank cut points inside its class.

    Rows are ordered inside their class by ``md5(id || seed)`` (ties by id);
    ``cuts(n_class)`` gives ascending ranks t_1 < t_2 < ...; a row of rank r
    gets part = #{t : t < r}. Equivalent to comparing ``row_number() OVER
    (PARTITION BY label ORDER BY md5, id)`` with the cuts, but no row is
    moved: a bucket histogram (classes x 65,536 rows at most) tells which hash
    bucket holds each cut, the ranks inside those few buckets (~n / 65,536 rows
    each, ids and labels only) give the hash and id at the cut, and these (one
    per cut and class) become literals that every row is compared with. So the
    result is a projection of ``df``: no shuffle, join or cache of the rows.
    Rows with a null label belong to no part and are left out.
    """
    df = df.where(F.col(label).isNotNull())
    h = seeded_hash(id_col, seed)
    keyed = df.select(label, id_col, h.alias("_h"),
                      F.conv(F.substring(h, 1, bucket_digits), 16, 10).cast("long").alias("_b"))
    hist = persist(keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_bn")))
    sizes = {r[label]: int(r["n"]) for r in hist.groupBy(label).agg(F.sum("_bn").alias("n")).collect()}
    if not sizes:
        hist.unpersist()
        return df.withColumn(out, F.lit(0)) if apply is None else apply(F.lit(0))
    cut_map = F.create_map(*[x for k, n in sizes.items() for x in (
        F.lit(k), F.array(F.lit(-1).cast("long"), *[F.lit(int(t)).cast("long") for t in cuts(n)]))])
    wcum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = hist.withColumn("_lo", F.coalesce(F.sum("_bn").over(wcum), F.lit(0)))
    held = F.filter(cut_map[F.col(label)], lambda t: (t > F.col("_lo")) & (t <= F.col("_lo") + F.col("_bn")))
    edges = buckets.select(F.col(label).alias("_l"), F.col("_b").alias("_eb"), "_lo", F.explode(F.array_distinct(held)).alias("_t"))
    w = Window.partitionBy("_l", "_eb", "_t").orderBy("_h", id_col)
    # one row per class and cut at most: the keys need not move to meet them
    at = (keyed.join(F.broadcast(edges), (F.col(label) == F.col("_l")) & (F.col("_b") == F.col("_eb")))
          .withColumn("_r", F.col("_lo") + F.row_number().over(w)).where("_r = _t").select("_l", "_t", "_h", id_col).collect())
    hist.unpersist()
    found = {(r["_l"], r["_t"]): (r["_h"], r[id_col]) for r in at}
    kind = df.schema[id_col].dataType
    part = None
    for k, n in sizes.items():
        beyond = F.lit(0)
        for t in cuts(n):
            if t < 1:
                beyond = beyond + 1
            elif (k, t) in found:
                ch, ci = found[k, t]
                beyond = beyond + ((h > ch) | ((h == ch) & (F.col(id_col) > F.lit(ci).cast(kind)))).cast("int")
        part = F.when(F.col(label) == k, beyond) if part is None else part.when(F.col(label) == k, beyond)
    return df.withColumn(out, part.cast("int")) if apply is None else apply(part.cast("int"))


def split_expression(keys: DataFrame, label: str, id_col: str, frac: float = 0.5, seed: int = SEED, out: str = "is_train"):
    """A function that flags the rows of any frame with the same ids and
    labels as ``keys`` (a narrow frame is enough to find the cuts)."""
    part = rank_parts(keys, label, id_col, lambda n: [int(math.floor(n * frac + 0.5))], seed, apply=lambda x: x)
    return lambda df: df.where(F.col(label).isNotNull()).withColumn(out, part == 0)


def split_stratified(df: DataFrame, label: str, id_col: str, frac: float = 0.5, seed: int = SEED,
                     out: str = "is_train") -> DataFrame:
    """Flag an exact stratified split: in each class the first
    ``round(frac * n_class)`` rows by seeded hash are train (half up)."""
    parts = rank_parts(df, label, id_col, lambda n: [int(math.floor(n * frac + 0.5))], seed)
    return parts.withColumn(out, F.col("_part") == 0).drop("_part")


def _fold_cuts(n: int, k: int) -> list[int]:
    return [(j * n) // k for j in range(1, k)]


def split_and_folds(df: DataFrame, label: str, id_col: str, frac: float = 0.5, k: int = 5, seed: int = SEED,
                    split_col: str = "is_train", fold_col: str = "fold") -> DataFrame:
    """Split flag and, for train rows, k contiguous stratified folds of the
    hashed order (fold -1 on test rows), from one set of rank cuts."""
    def cuts(n):
        n_train = int(math.floor(n * frac + 0.5))
        return _fold_cuts(n_train, k) + [n_train]     # coinciding cuts count twice, as defined
    parts = rank_parts(df, label, id_col, cuts, seed)
    return (parts.withColumn(split_col, F.col("_part") < k)
            .withColumn(fold_col, F.when(F.col("_part") < k, F.col("_part")).otherwise(-1).cast("int"))
            .drop("_part"))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = SEED,
                     out: str = "fold") -> DataFrame:
    """Stratified k folds: each class's hashed order cut into k contiguous
    blocks of sizes differing by at most one."""
    return rank_parts(df, label, id_col, lambda n: _fold_cuts(n, k), seed, out)


# ------------------------------------------------------------------ scaling

def fit_standardize(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column from one aggregate row (p numbers)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_standardize(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """(x - mean) / std; a zero std scales by 1 (constant columns become 0)."""
    for c, (m, s) in stats.items():
        scale = s if s and s > 0 else 1.0
        df = df.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(scale))
    return df


def standardize(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return apply_standardize(df, fit_standardize(train if train is not None else df, cols))


# ---------------------------------------------------------------- imputing

def fit_modes(train: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column (ties: smallest), by grouped counts."""
    from callsheet.operators.explore import common_features
    cf = common_features(train, cols).select("feature", "mode_num", "mode_str").collect()
    types = dict(train.dtypes)
    out = {}
    for r in cf:
        if types[r["feature"]] == "string":
            out[r["feature"]] = r["mode_str"]
        else:
            out[r["feature"]] = r["mode_num"]
    return out


def impute_mode(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    modes = fit_modes(train if train is not None else df, cols)
    return df.fillna({c: v for c, v in modes.items() if v is not None})


# ---------------------------------------------------------------- encoding

def one_hot_stages(cols: Sequence[str], order: str = "alphabetAsc", drop_last: bool = True,
                   suffix: str = "_oh") -> list:
    """StringIndexer(keep) + OneHotEncoder(dropLast): with ``alphabetAsc`` the
    dropped slot is the 'unknown' bucket, so every seen category has a slot
    and an unseen or null one encodes as all zeros."""
    # one multi-column indexer: all label sets come from a single pass
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], stringOrderType=order,
                        handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}{suffix}" for c in cols],
                        dropLast=drop_last)
    return [idx, ohe]


def one_hot(train: DataFrame, cols: Sequence[str], df: DataFrame | None = None) -> DataFrame:
    model = Pipeline(stages=one_hot_stages(cols)).fit(train)
    return model.transform(df if df is not None else train)


def dummies(train: DataFrame, col: str, df: DataFrame | None = None) -> DataFrame:
    """Indicators minus the alphabetically first category (drop-first dummies)."""
    idx = StringIndexer(inputCol=col, outputCol=f"{col}_idx", stringOrderType="alphabetDesc",
                        handleInvalid="error")
    ohe = OneHotEncoder(inputCols=[f"{col}_idx"], outputCols=[f"{col}_dummies"], dropLast=True)
    return Pipeline(stages=[idx, ohe]).fit(train).transform(df if df is not None else train)


class FeaturePrep:
    """Numeric branch (scaled) + categorical branch (mode-imputed, one-hot),
    assembled into one ``features`` vector. Fit on train only, then applied
    to any frame (test, full table, a stream)."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], out: str = "features",
                 scale: bool = True):
        self.numeric, self.categorical, self.out, self.scale = list(numeric), list(categorical), out, scale
        self.modes: dict | None = None
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame) -> "FeaturePrep":
        self.modes = fit_modes(train, self.categorical) if self.categorical else {}
        stages = []
        inputs = []
        if self.numeric:
            stages.append(VectorAssembler(inputCols=self.numeric, outputCol="_num", handleInvalid="keep"))
            if self.scale:
                stages.append(StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True))
                inputs.append("_num_s")
            else:
                inputs.append("_num")
        if self.categorical:
            stages += one_hot_stages(self.categorical)
            inputs += [f"{c}_oh" for c in self.categorical]
        stages.append(VectorAssembler(inputCols=inputs, outputCol=self.out))
        self.model = Pipeline(stages=stages).fit(self._fill(train))
        return self

    def _fill(self, df: DataFrame) -> DataFrame:
        fill = {c: v for c, v in (self.modes or {}).items() if v is not None}
        return df.fillna(fill) if fill else df

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        out = self.model.transform(self._fill(df))
        if keep is not None:
            out = out.select(*keep, self.out)
        return out

    def feature_names(self) -> list[str]:
        """Slot names of the assembled vector (numeric names, then
        ``column=category`` per one-hot slot)."""
        names = list(self.numeric)
        for st in self.model.stages:
            if st.__class__.__name__ == "StringIndexerModel":
                for c, labels in zip(st.getInputCols(), st.labelsArray):
                    names += [f"{c}={v}" for v in labels]
        return names
