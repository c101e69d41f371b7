"""Fitted closed-form models score a stream the same way as a batch."""

from pyspark.sql import functions as F

from callsheet.functions.columns import yes_no
from callsheet.operators import models as MD
from callsheet.session import scratch_path
from callsheet.sources.clients import NUMERIC, clients
from callsheet.sources.io import write_table
from callsheet.streaming import score_stream


def test_stream_scores_like_batch(spark):
    c = clients(spark, "/root/testdata/sf0.001").withColumn("label", yes_no("y"))
    model = MD.nearest_centroid(c, NUMERIC, "label")
    path = write_table(c, scratch_path(spark, "stream-src"))
    stream = spark.readStream.schema(c.schema).parquet(path)
    q = (score_stream(stream, model).select("client_id", "prediction")
         .writeStream.format("memory").queryName("scored_clients").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r[0]: r[1] for r in spark.sql("SELECT * FROM scored_clients").collect()}
    want = {r[0]: r[1] for r in model.transform(c).select("client_id", "prediction").collect()}
    assert got == want and len(got) > 0
