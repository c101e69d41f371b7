"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column layout of the campaign client file (one row per client contact).
CLIENT_FILE_SCHEMA = T.StructType([
    T.StructField("age", T.IntegerType()),
    T.StructField("job", T.StringType()),
    T.StructField("marital", T.StringType()),
    T.StructField("education", T.StringType()),
    T.StructField("default", T.StringType()),
    T.StructField("balance", T.IntegerType()),
    T.StructField("housing", T.StringType()),
    T.StructField("loan", T.StringType()),
    T.StructField("contact", T.StringType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("month", T.StringType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("campaign", T.IntegerType()),
    T.StructField("y", T.StringType()),
])


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet test tables (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_clients(spark: SparkSession, path: str, schema: T.StructType | None = CLIENT_FILE_SCHEMA,
                 fmt: str = "csv") -> DataFrame:
    """Read a client file with a header row.

    An explicit schema avoids the extra pass of type inference; pass
    ``schema=None`` to infer the types like a notebook would.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def sql_over(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text over DataFrames bound by name: ``sql_over(spark, "SELECT * FROM {df}", df=x)``."""
    return spark.sql(query, **frames)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a result table; CSV gets a header row."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
