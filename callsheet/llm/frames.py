"""Small Spark helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.session import scratch_path

#: A side is broadcast only if it holds at most so many rows and bytes.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Spark's setting by which a finished execution's shuffle files go at once
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: words ``[^\x20\x09-\x0D]+``
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, codec: str = "zstd", free: bool = False) -> DataFrame:
    """Write ``df`` below the cluster's shared checkpoint folder and read it
    back: lineage is cut and what is read twice is computed once. ``free``: the
    frame is done with then, and so are its shuffle files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true" if free else before)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes are within the
    bounds, else unchanged (the planner then shuffles). ``width``: bytes of a
    row, 64 if not given. ``df`` should be cheap to read."""
    got = df.select(F.count(F.lit(1)).alias("n"), F.sum(F.lit(64) if width is None else width).alias("b")).first()
    return F.broadcast(df) if got.n <= BROADCAST_ROWS and (got.b or 0) <= BROADCAST_BYTES else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that an operator is about to add, so that input
    columns of the same name (in any case) are replaced, not doubled."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def with_fields(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """Schema of ``df`` with fields added at its end."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in fields.items()]])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.expr(f"regexp_count(`{text}`, r'{WORD}')"), F.lit(0)).cast("long")
