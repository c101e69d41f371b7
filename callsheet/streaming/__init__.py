"""Scoring client records that arrive as a stream.

The reference has no streaming operators (no windows, watermarks or state),
so nothing stateful is built here. What carries over is a property: the
fitted encoders and closed-form models are pure column expressions, so the
same fitted objects score a Structured Streaming frame exactly as they
score a batch frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsheet.sources.io import CLIENT_FILE_SCHEMA


def read_client_stream(spark: SparkSession, path: str, fmt: str = "csv", schema=CLIENT_FILE_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Client files landing in a folder as a streaming frame (explicit schema,
    as streaming sources require)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def score_stream(stream: DataFrame, *fitted) -> DataFrame:
    """Apply fitted transformers in order (e.g. a ``FeaturePrep``, then a
    closed-form model) to a streaming frame; stateless, so append mode."""
    out = stream
    for f in fitted:
        out = f.transform(out)
    return out
