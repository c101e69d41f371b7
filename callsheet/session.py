"""Session helpers: building a session, the shared checkpoint folder and
size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count we will ever broadcast from a side whose size is not
# fixed by construction. Above it the join is left to a shuffle join.
BROADCAST_MAX_ROWS = 1_000_000


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "callsheet") -> SparkSession:
    """Session for tests and the bench; on a cluster use the existing one."""
    master = master or os.environ.get("CALLSHEET_MASTER", "local[8]")
    partitions = partitions or int(os.environ.get("CALLSHEET_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is; only when the
    setting is unset and the master is local (tests) a scratch folder is
    created and set. On a cluster without the setting this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        # a machine-local folder would not survive the loss of an executor
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
    local = tempfile.mkdtemp(prefix="callsheet-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` so it stops early on a big
    side. Beyond the bound the frame is returned untouched and Catalyst/AQE
    pick a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def persist(df: DataFrame) -> DataFrame:
    """Keep a frame that an iterative fit scans many times; partitions that
    do not fit in memory spill to local disk, lost ones are recomputed from
    lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: rows of a task whose work on a row is heavy (a model's pass, distances)
TASK_ROWS = 25_000


def spread(df: DataFrame, key: str, n: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by the hash of ``key`` so that a task has about
    ``task_rows`` of its ``n`` rows. The planner sizes a join's partitions by
    their bytes, and so many narrow rows are a few tasks, however long each
    row takes; a frame of at most ``task_rows`` rows is left as it is."""
    parts = -(-n // task_rows)
    return df.repartition(parts, F.xxhash64(F.col(key))) if parts > 1 else df


def materialize(df: DataFrame, *inputs: DataFrame) -> DataFrame:
    """Persist ``df`` and fill the cache now, then release the persisted
    ``inputs`` it was computed from (several fits will scan ``df``)."""
    out = persist(df)
    out.count()
    for i in inputs:
        i.unpersist()
    return out
