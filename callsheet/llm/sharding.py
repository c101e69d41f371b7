"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

The rows lie in p partitions. A p x k matrix says how many rows each partition
sends to each shard; drawn from the multivariate hypergeometric law it is
distributed as in a uniform permutation of all rows, at every size, and its margins are exact:
rows per partition, and shard sizes at most one apart. Each partition permutes
its rows and cuts them by its row of the matrix; the rows are exchanged, and
every shard permutes again. All of it is DataFrame work; only p row counts go
to the driver, and the matrix (p x k integers) is written as a table, ``CELLS`` rows at a time.

The first permutation is a sort within the partitions by a hash of each row's
place (never of its content: equal rows scatter like any others). Its outcome
is written once with each row's new place, so that a lost executor can't move a
row: whatever is computed again reads the same places. The second permutation orders by a
hash of the place as well, in up to ``SLOTS_PER_BLOCK`` rows
per sort: a shard is cut into blocks by hash, and block offsets make its slots
gapless. So neither equal rows nor a small number of shards make a hot task.

Defined cases: null, empty, long and repeated texts and ids are rows like any
other; no rows give no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsheet.llm import frames
from callsheet.session import scratch_path

SLOTS_PER_BLOCK = 4_000
CELLS = 5_000
#: numpy draws from fewer than so many rows
MOST = 10**9


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard: a multivariate
    hypergeometric draw whose rows sum to ``counts`` and whose columns are the
    shard sizes, at most one apart (the larger ones are drawn as well)."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[:total % shards]] += 1
    out = []
    for n in counts:
        # n draws without replacement from the room left, shard by shard
        row, left, rest = np.zeros(shards, np.int64), n, int(room.sum())
        for j in range(shards):
            rest -= int(room[j])
            row[j] = _draw(rng, int(room[j]), rest, left)
            left -= int(row[j])
        room -= row
        out.append(row.tolist())
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric, exact at any size. Past numpy's limit a binomial draw is
    kept with the ratio of the two laws, which is highest at ``mode``; of n and
    the rows left over the smaller number is drawn, so at least two of three are kept."""
    if good + bad < MOST:
        return int(rng.hypergeometric(good, bad, n)) if good + bad else 0
    if not good or not bad or not n:
        return n if not bad else 0
    if 2 * n > good + bad:
        return good - _draw(rng, good, bad, good + bad - n)
    mode = -(-(n - 1) * good // (good + bad))
    while True:
        k = int(rng.binomial(n, good / (good + bad)))
        if max(0, n - bad) <= k <= min(n, good) and np.log(rng.random()) <= _log_ratio(good, bad, n, mode, k):
            return k


def _log_ratio(good: int, bad: int, n: int, mode: int, k: int) -> float:
    """log of hypergeometric by binomial at k, less that at ``mode``: the
    product of (1 - i / good) over i < k and (1 - j / bad) over j < n - k."""
    lo, hi = min(k, mode), max(k, mode)
    total = 0.0
    for a in range(lo, hi, 1 << 20):
        i = np.arange(a, min(a + (1 << 20), hi), dtype=float)
        total += float(np.sum(np.log1p(-i / good) - np.log1p(-(n - 1 - i) / bad)))
    return total if k > mode else -total


def _place_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("_part"), F.col("_at"))


def shard(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """``docs`` in a uniformly random order, with ``shard`` (0 to shards - 1,
    sizes at most one apart) and ``slot`` (place in the shard, from 0)."""
    out = frames.without(docs, ["shard", "slot", "_part", "_at", "_id"])
    place = F.monotonically_increasing_id()
    permuted = out.withColumn("_id", place).withColumn("_id", F.xxhash64(F.lit(seed), "_id")).sortWithinPartitions("_id").withColumn("_id", place) \
        .withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    permuted = frames.stored(permuted, "permuted")
    counts = permuted.groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    spark = docs.sparkSession
    cells = [[r["_part"], *np.cumsum(row).tolist()] for r, row in zip(counts, matrix)]
    path = scratch_path(spark, "matrix")
    for a in range(0, max(len(cells), 1), CELLS):
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cells[a:a + CELLS])), "array<array<bigint>>")).alias("c"))
        rows.select(F.element_at("c", 1).alias("_p"), F.slice("c", 2, shards).alias("_cuts")).write.mode("append").parquet(path)
    cuts = spark.read.schema("_p long, _cuts array<bigint>").parquet(path)
    # the shard of a row: how many of its partition's cuts lie at or before its place
    to = F.size(F.filter("_cuts", lambda c: c <= F.col("_at")))
    total = sum(r["count"] for r in counts)
    blocks = max(1, -(-total // (shards * SLOTS_PER_BLOCK)))
    sent = permuted.join(frames.small(cuts, F.lit(16 + 8 * shards)), F.col("_part") == F.col("_p")) \
        .withColumn("shard", to.cast("int")) \
        .withColumn("_block", F.pmod(_place_hash(seed + 1), F.lit(blocks)).cast("int")).drop("_p", "_cuts")
    # offsets of the blocks from the places alone, so that texts are exchanged once
    sizes = sent.groupBy("shard", "_block").count()
    w = Window.partitionBy("shard").orderBy("_block")
    before = sizes.select(F.col("shard").alias("_s"), F.col("_block").alias("_b"),
                          (F.sum("count").over(w) - F.col("count")).alias("_before"))
    before = frames.small(frames.stored(before, "blocks"), F.lit(24))
    inner = Window.partitionBy("shard", "_block").orderBy(_place_hash(seed + 2), "_part", "_at")
    ranked = sent.withColumn("_rank", F.row_number().over(inner) - 1)
    return ranked.join(before, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))) \
        .withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")) \
        .select(*[F.col(f"`{c}`") for c in out.columns], "shard", "slot")
