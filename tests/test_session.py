"""Size-checked broadcast and the shared checkpoint folder."""

from pyspark.sql import functions as F

from callsheet.session import broadcast_if_small, ensure_checkpoint_dir, scratch_path


def _hinted(df) -> bool:
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_only_within_bound(spark):
    small = spark.range(10)
    assert _hinted(broadcast_if_small(small, max_rows=100))
    assert not _hinted(broadcast_if_small(spark.range(1000), max_rows=100))


def test_checkpoint_dir_is_kept_and_scratch_is_below_it(spark):
    d = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == d
    assert scratch_path(spark, "x").startswith(d.rstrip("/"))


def test_spread_deals_rows_by_their_number(spark):
    from callsheet.session import spread
    df = spark.range(0, 1000, 1, 1)
    some = spread(df, "id", 1000, 100)
    sizes = [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    assert some.agg(F.sum("id")).first()[0] == 499500
    assert spread(df, "id", 1000, 1000) is df
