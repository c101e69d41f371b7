"""The ``clients`` frame: the campaign client table bound to the test tables.

One row per order. Column roles follow the campaign file: categoricals
(job, contact, education, month), numerics (balance, amount, day, duration,
campaign) and the yes/no label ``y`` as the last column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.functions.columns import Levels
from callsheet.sources.io import load_table

CATEGORICAL = ["job", "contact", "education", "month"]
NUMERIC = ["balance", "amount", "day", "duration", "campaign"]
LABEL = "y"
# The levels of the test tables' categorical columns.
LEVELS = {
    "job": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "contact": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "education": [f"NATION_{i}" for i in range(25)],
    "month": [f"{m:02d}" for m in range(1, 13)],
}


def indicator_names(cols) -> list[str]:
    return [f"{c}_is_{i}" for c in cols for i in range(len(LEVELS[c]))]


def level_features(cols) -> list[Levels]:
    """The features of :func:`indicator_names`, in the same order, not written out."""
    return [Levels(c, tuple(LEVELS[c])) for c in cols]


def with_indicators(df: DataFrame, cols=tuple(CATEGORICAL)) -> DataFrame:
    """One 0/1 column per level, all 0 for a null or unknown value: the
    encoded table as named columns, for fits that have a SQL twin."""
    return df.select("*", *[F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_is_{i}")
                            for c in cols for i, v in enumerate(LEVELS[c])])


def indicators_sql(cols=tuple(CATEGORICAL)) -> str:
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_is_{i}"
                     for c in cols for i, v in enumerate(LEVELS[c]))


ID = "client_id"


def clients(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """Build the client table from orders, customer, nation and lineitem.

    Plan shape: lineitem is pre-aggregated per order (partial + final hash
    aggregate) before it meets orders, so only one row per order crosses the
    join shuffle; nation is tiny and broadcast by the planner from its file
    size; customer is joined on its key by a shuffle join, not a broadcast,
    because it grows with the data. Left joins keep every order. ``columns``
    names the columns that are needed: tables that none of them comes from
    are not read at all (their keys are unique, so no row is lost or doubled).
    """
    of = {
        "client_id": (F.col("o_orderkey"), None), "job": (F.col("c_mktsegment"), "customer"),
        "contact": (F.col("o_orderpriority"), None), "education": (F.col("n_name"), "nation"),
        "balance": (F.col("c_acctbal").cast("double"), "customer"), "amount": (F.col("o_totalprice").cast("double"), None),
        "day": (F.dayofmonth("o_orderdate").cast("int"), None),
        "month": (F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), None),
        "duration": (F.coalesce(F.col("l_qty").cast("double"), F.lit(0.0)), "lineitem"),
        "campaign": (F.coalesce(F.col("l_cnt"), F.lit(0)).cast("long"), "lineitem"),
        "y": (F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no"), None),
    }
    columns = [c for c in of if columns is None or c in columns]
    sides = {of[c][1] for c in columns}
    joined = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    if "lineitem" in sides:
        per_order = (load_table(spark, sf_dir, "lineitem")
                     .groupBy("l_orderkey")
                     .agg(F.sum("l_quantity").alias("l_qty"), F.count(F.lit(1)).alias("l_cnt")))
        joined = joined.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if sides & {"customer", "nation"}:
        customer = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
        joined = joined.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "nation" in sides:
        nation = load_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        joined = joined.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(*[of[c][0].alias(c) for c in columns])


def clients_sql() -> str:
    """The same table as ANSI SQL over the raw tables (used by the oracle)."""
    return """
    SELECT o.o_orderkey AS client_id,
           c.c_mktsegment AS job,
           o.o_orderpriority AS contact,
           n.n_name AS education,
           CAST(c.c_acctbal AS DOUBLE) AS balance,
           CAST(o.o_totalprice AS DOUBLE) AS amount,
           CAST(day(o.o_orderdate) AS INTEGER) AS day,
           lpad(CAST(month(o.o_orderdate) AS VARCHAR), 2, '0') AS month,
           COALESCE(CAST(li.l_qty AS DOUBLE), 0.0) AS duration,
           CAST(COALESCE(li.l_cnt, 0) AS BIGINT) AS campaign,
           CASE WHEN o.o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS y
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS l_qty, COUNT(*) AS l_cnt
               FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    """
