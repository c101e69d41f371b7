"""Profiling queries over the clients table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsheet.functions.columns import recode, yes_no
from callsheet.operators import explore as X
from callsheet.operators import summaries as SM
from callsheet.operators.quantiles import exact_quantiles
from callsheet.plans.registry import long_sql, query, typed_long_sql
from callsheet.session import scratch_path
from callsheet.sources.clients import CATEGORICAL, NUMERIC, clients
from callsheet.sources.io import load_clients, load_table, sql_over, write_table

# Fixed values (the notebooks' per-column display cutoffs, strict upper bounds):
CUTOFFS = {"balance": 10000, "duration": 2000, "campaign": 10}
ALL_COLS = CATEGORICAL + NUMERIC

# Fixed price bands standing in for a segment id where a SQL-checkable key
# is needed (the model-made segment ids are checked by row counts instead).
BAND_EDGES = (170000.0, 340000.0)
BAND_SQL = (f"CASE WHEN amount < {BAND_EDGES[0]} THEN 0 WHEN amount < {BAND_EDGES[1]} THEN 1 "
            f"ELSE 2 END AS cluster")


def banded(spark, sf_dir) -> DataFrame:
    c = clients(spark, sf_dir)
    band = (F.when(F.col("amount") < BAND_EDGES[0], 0).when(F.col("amount") < BAND_EDGES[1], 1)
            .otherwise(2)).cast("int")
    return c.withColumn("cluster", band)


BANDED_CTE = f"banded AS (SELECT *, {BAND_SQL} FROM clients)"
R_CLIENT = ("balance", "amount", "duration")

# ---------------------------------------------------------------- 2.1 sources


@query("scan_clients", "SELECT * FROM clients", rnd=R_CLIENT)
def q_scan_clients(spark, sf_dir):
    return clients(spark, sf_dir)


@query("sql_filter_view", "SELECT * FROM clients WHERE y = 'yes'", rnd=R_CLIENT)
def q_sql_filter_view(spark, sf_dir):
    return sql_over(spark, "SELECT * FROM {df} WHERE y = 'yes'", df=clients(spark, sf_dir))


@query("write_table", "SELECT * FROM clients", rnd=R_CLIENT)
def q_write_table(spark, sf_dir):
    path = write_table(clients(spark, sf_dir), scratch_path(spark, "clients"), fmt="parquet")
    return spark.read.parquet(path)


def _as_csv(spark, sf_dir):
    c = clients(spark, sf_dir)
    return c.schema, write_table(c, scratch_path(spark, "clients-csv"), fmt="csv")


@query("scan_clients_csv", "SELECT * FROM clients", rnd=R_CLIENT)
def q_scan_csv(spark, sf_dir):
    """Delimited sink and source, with the schema given."""
    schema, path = _as_csv(spark, sf_dir)
    return load_clients(spark, path, schema)


@query("scan_clients_inferred", "SELECT * FROM clients", rnd=R_CLIENT)
def q_scan_inferred(spark, sf_dir):
    """The same with types inferred; month comes back as a number."""
    schema, path = _as_csv(spark, sf_dir)
    got = load_clients(spark, path, None).withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    return got.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


_ROLES = {**{c: "numeric" for c in ["client_id", *NUMERIC]}, **{c: "categorical" for c in CATEGORICAL}}


@query("column_roles", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{r}' AS role, COUNT({c}) AS n, COUNT(DISTINCT {c}) AS n_distinct FROM clients"
                                          for c, r in _ROLES.items()))
def q_column_roles(spark, sf_dir):
    """Every column's role by its type, its values and its distinct values."""
    return X.column_figures(clients(spark, sf_dir), "y")


# ------------------------------------------------ 2.2 projections and filters


@query("select_features", "SELECT client_id, job, contact, education, balance, amount, day, month, "
       "duration, campaign FROM clients", rnd=R_CLIENT)
def q_select_features(spark, sf_dir):
    return X.select_features(clients(spark, sf_dir))


@query("drop_leaky", "SELECT client_id, job, contact, education, balance, amount FROM clients",
       rnd=("balance", "amount"))
def q_drop_leaky(spark, sf_dir):
    return X.drop_columns(clients(spark, sf_dir), ["duration", "month", "day", "campaign", "y"])


@query("recode_label", "SELECT client_id, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM clients")
def q_recode_label(spark, sf_dir):
    return clients(spark, sf_dir).select("client_id", yes_no("y").alias("label"))


@query("relabel_clusters", f"WITH {BANDED_CTE} SELECT client_id, cluster, "
       "CASE WHEN cluster = 2 THEN 1 WHEN cluster = 1 THEN 2 ELSE cluster END AS relabeled FROM banded")
def q_relabel_clusters(spark, sf_dir):
    b = banded(spark, sf_dir)
    return b.select("client_id", "cluster", recode("cluster", {2: 1, 1: 2}).alias("relabeled"))


@query("filter_eq", f"WITH {BANDED_CTE} SELECT client_id, job, balance, cluster FROM banded WHERE cluster = 1",
       rnd=("balance",))
def q_filter_eq(spark, sf_dir):
    return X.filter_eq(banded(spark, sf_dir), "cluster", 1).select("client_id", "job", "balance", "cluster")


@query("filter_cutoff", "SELECT * FROM clients WHERE balance < 10000 AND duration < 2000 AND campaign < 10",
       rnd=R_CLIENT)
def q_filter_cutoff(spark, sf_dir):
    return X.cutoff(clients(spark, sf_dir), CUTOFFS)


@query("coalesce_fill",
       "SELECT o.o_orderkey AS client_id, COALESCE(li.qty, 0) AS duration, COALESCE(li.cnt, 0) AS campaign "
       "FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_quantity) AS qty, COUNT(*) AS cnt FROM lineitem "
       "GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey", rnd=("duration",))
def q_coalesce_fill(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey")
    li = (load_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.sum("l_quantity").alias("duration"), F.count(F.lit(1)).alias("campaign")))
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    return X.fill_zero(j.select(F.col("o_orderkey").alias("client_id"), "duration", "campaign"),
                       ["duration", "campaign"])


@query("tag_literal", f"WITH {BANDED_CTE} SELECT cluster AS id, COUNT(*) AS n FROM banded GROUP BY cluster "
       "UNION ALL SELECT 4 AS id, COUNT(*) AS n FROM banded")
def q_tag_literal(spark, sf_dir):
    b = banded(spark, sf_dir)
    whole = X.tag(b, "id", 4)
    parts = b.withColumn("id", F.col("cluster"))
    return (parts.unionByName(whole).groupBy("id").agg(F.count(F.lit(1)).alias("n")))


@query("log_shift", "SELECT client_id, ln(balance - (SELECT MIN(balance) FROM clients) + 1) AS balance_log "
       "FROM clients", rnd=("balance_log",))
def q_log_shift(spark, sf_dir):
    return X.log_shift(clients(spark, sf_dir), "balance", "balance_log").select("client_id", "balance_log")


@query("distinct_values", "SELECT DISTINCT job FROM clients")
def q_distinct_values(spark, sf_dir):
    return X.distinct_values(clients(spark, sf_dir), "job")


# ------------------------------------------------------------------ 2.3 join

DENSE_SQL = """
WITH spine AS (
  SELECT k.day, c.y FROM
    (SELECT CAST(unnest(generate_series(MIN(day), MAX(day))) AS BIGINT) AS day FROM clients) k,
    (SELECT DISTINCT y FROM clients WHERE y IS NOT NULL) c),
counts AS (SELECT CAST(day AS BIGINT) AS day, y, COUNT(*) AS n_obs FROM clients
           WHERE day IS NOT NULL AND y IS NOT NULL GROUP BY day, y)
SELECT COALESCE(s.day, c.day) AS day, COALESCE(s.y, c.y) AS y, CAST(COALESCE(c.n_obs, 0) AS BIGINT) AS n
FROM spine s FULL OUTER JOIN counts c ON s.day = c.day AND s.y = c.y
"""


@query("spine_outer_join", DENSE_SQL)
def q_spine_outer_join(spark, sf_dir):
    return X.dense_counts(clients(spark, sf_dir), "day", "y")


# ---------------------------------------------------------- 2.4 aggregations

def _describe_sql(src: str, cols, keep=()) -> str:
    k = "".join(f"{c}, " for c in keep)
    g = f"GROUP BY {', '.join(keep)}, feature" if keep else "GROUP BY feature"
    return (f"SELECT {k}feature, COUNT(value) AS count, AVG(value) AS mean, STDDEV_SAMP(value) AS std, "
            f"MIN(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, "
            f"quantile_cont(value, 0.75) AS p75, MAX(value) AS max FROM ({long_sql(src, cols, keep, False)}) "
            f"AS _l {g}")


R_DESC = ("mean", "std", "min", "p25", "p50", "p75", "max")


@query("describe_numeric", _describe_sql("clients", NUMERIC), rnd=R_DESC)
def q_describe_numeric(spark, sf_dir):
    return X.describe(clients(spark, sf_dir), NUMERIC)


@query("value_counts", f"SELECT feature, value, COUNT(*) AS n FROM ({long_sql('clients', CATEGORICAL)}) AS _l "
       "WHERE value IS NOT NULL GROUP BY feature, value")
def q_value_counts(spark, sf_dir):
    return X.value_counts(clients(spark, sf_dir), CATEGORICAL)


@query("count_by_class", f"SELECT feature, value, y, COUNT(*) AS n FROM ({long_sql('clients', CATEGORICAL, ['y'])}) "
       "AS _l WHERE value IS NOT NULL AND y IS NOT NULL GROUP BY feature, value, y")
def q_count_by_class(spark, sf_dir):
    return X.count_by(clients(spark, sf_dir), CATEGORICAL, "y")


def _pivot_sql(src_long: str, by: str, values, name=lambda v: v, lit=lambda v: f"'{v}'") -> str:
    cols = ", ".join(f"NULLIF(COUNT(*) FILTER (WHERE {by} = {lit(v)}), 0) AS \"{name(v)}\"" for v in values)
    return f"SELECT feature, value, {cols} FROM ({src_long}) AS _l WHERE value IS NOT NULL GROUP BY feature, value"


@query("crosstab_pivot", _pivot_sql(long_sql("clients", CATEGORICAL, ["y"]), "y", ["no", "yes"]))
def q_crosstab_pivot(spark, sf_dir):
    return X.crosstab(clients(spark, sf_dir), CATEGORICAL, "y", ["no", "yes"])


@query("positives_by_category",
       _pivot_sql(f"SELECT * FROM ({long_sql('clients', CATEGORICAL, ['y'])}) AS _p WHERE y = 'yes'", "y", ["yes"]))
def q_positives_by_category(spark, sf_dir):
    return X.crosstab(X.filter_eq(clients(spark, sf_dir), "y", "yes"), CATEGORICAL, "y", ["yes"])


SEGMENT_RATE_SQL = f"""
SELECT feature, value, COUNT(*) AS n, CAST(SUM(pos) AS BIGINT) AS positives,
       CASE WHEN COUNT(*) = 0 THEN 0.0 ELSE CAST(SUM(pos) AS DOUBLE) / COUNT(*) END AS rate
FROM ({long_sql("(SELECT *, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS pos FROM clients WHERE y IS NOT NULL)",
                CATEGORICAL, ['pos'])}) AS _l
WHERE value IS NOT NULL GROUP BY feature, value
"""


@query("segment_rate", SEGMENT_RATE_SQL, rnd=("rate",))
def q_segment_rate(spark, sf_dir):
    return X.segment_rate(clients(spark, sf_dir), CATEGORICAL, "y", "yes")


@query("crosstab_by_cluster",
       f"WITH {BANDED_CTE} " + _pivot_sql(long_sql("banded", CATEGORICAL, ["cluster"]), "cluster", [0, 1, 2],
                                          name=str, lit=str))
def q_crosstab_by_cluster(spark, sf_dir):
    return X.crosstab(banded(spark, sf_dir), CATEGORICAL, "cluster", [0, 1, 2])


CORR_COLS = NUMERIC + ["label"]


def _corr_sql() -> str:
    src = "(SELECT *, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM clients)"
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            for x, z in ((a, b), (b, a)):
                parts.append(f"SELECT '{x}' AS a, '{z}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r "
                             f"FROM {src}")
    for c in CORR_COLS:
        parts.append(f"SELECT '{c}' AS a, '{c}' AS b, 1.0 AS r")
    return " UNION ALL ".join(parts)


@query("corr_matrix", _corr_sql(), rnd=("r",))
def q_corr_matrix(spark, sf_dir):
    c = clients(spark, sf_dir).withColumn("label", yes_no("y"))
    return X.corr_matrix(c, CORR_COLS)


@query("base_rate", "SELECT COUNT(y) AS n, CAST(SUM(CASE WHEN y = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS positives, "
       "CAST(COUNT(y) - SUM(CASE WHEN y = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS negatives, "
       "AVG(CASE WHEN y IS NULL THEN NULL WHEN y = 'yes' THEN 1.0 ELSE 0.0 END) AS rate FROM clients",
       rnd=("rate",))
def q_base_rate(spark, sf_dir):
    return X.base_rate(clients(spark, sf_dir))


@query("dense_counts", DENSE_SQL)
def q_dense_counts(spark, sf_dir):
    return X.dense_counts(clients(spark, sf_dir), "day", "y")


@query("stacked_counts", f"SELECT day, CAST(SUM(n) FILTER (WHERE y = 'no') AS BIGINT) AS no, "
       f"CAST(SUM(n) FILTER (WHERE y = 'yes') AS BIGINT) AS yes FROM ({DENSE_SQL}) AS _d GROUP BY day")
def q_stacked_counts(spark, sf_dir):
    return X.stacked_counts(clients(spark, sf_dir), "day", "y", ["no", "yes"])


def _cut_long_sql(src: str, by: str) -> str:
    long = long_sql(src, NUMERIC, [by], as_text=False)
    conds = " AND ".join(f"NOT (feature = '{k}' AND value >= {float(v)})" for k, v in CUTOFFS.items())
    return f"SELECT * FROM ({long}) AS _l WHERE value IS NOT NULL AND {conds}"


def _distribution_sql(src: str, by: str) -> str:
    return (f"SELECT feature, {by}, COUNT(value) AS n, AVG(value) AS mean, MIN(value) AS min, "
            f"quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, "
            f"quantile_cont(value, 0.75) AS p75, MAX(value) AS max FROM ({_cut_long_sql(src, by)}) AS _c "
            f"GROUP BY feature, {by}")


R_DIST = ("mean", "min", "p25", "p50", "p75", "max")


@query("distribution_by_class", _distribution_sql("clients", "y"), rnd=R_DIST)
def q_distribution_by_class(spark, sf_dir):
    return X.distribution(clients(spark, sf_dir), NUMERIC, "y", CUTOFFS)


@query("distribution_by_cluster", f"WITH {BANDED_CTE} " + _distribution_sql("banded", "cluster"), rnd=R_DIST)
def q_distribution_by_cluster(spark, sf_dir):
    return X.distribution(banded(spark, sf_dir), NUMERIC, "cluster", CUTOFFS)


HIST_BINS = 20
HIST_SQL = f"""
WITH c AS ({_cut_long_sql('clients', 'y')}),
e AS (SELECT feature, MIN(value) AS lo0, MAX(value) AS hi0 FROM c GROUP BY feature),
b AS (SELECT c.feature, c.y, e.lo0, (e.hi0 - e.lo0) / {HIST_BINS} AS w,
             CAST(CASE WHEN e.hi0 = e.lo0 THEN 0
                       ELSE LEAST(FLOOR((c.value - e.lo0) / ((e.hi0 - e.lo0) / {HIST_BINS})), {HIST_BINS - 1}) END
                  AS INTEGER) AS bin
      FROM c JOIN e ON c.feature = e.feature)
SELECT feature, y, bin, lo0 + bin * w AS lo, lo0 + (bin + 1) * w AS hi, COUNT(*) AS n
FROM b GROUP BY feature, y, bin, lo0, w
"""


@query("histogram_by_class", HIST_SQL, rnd=("lo", "hi"))
def q_histogram_by_class(spark, sf_dir):
    return X.histogram(clients(spark, sf_dir), NUMERIC, "y", HIST_BINS, CUTOFFS)


def _common_sql(src: str, cols, keep=()) -> str:
    k = "".join(f"{c}, " for c in keep)
    part = f"PARTITION BY {', '.join(keep)}, feature" if keep else "PARTITION BY feature"
    on = " AND ".join(f"m.{c} = s.{c}" for c in list(keep) + ["feature"])
    mk = "".join(f"m.{c}, " for c in keep)
    nums = [c for c in cols if c in NUMERIC]
    modes = f"""
      SELECT {k}feature, count, num_value AS mode_num, str_value AS mode_str, _n AS mode_n FROM (
        SELECT *, ROW_NUMBER() OVER ({part} ORDER BY _n DESC, num_value ASC NULLS FIRST,
                                     str_value ASC NULLS FIRST) AS rn,
               CAST(SUM(_n) OVER ({part}) AS BIGINT) AS count
        FROM (SELECT {k}feature, num_value, str_value, COUNT(*) AS _n
              FROM ({typed_long_sql(src, cols, set(NUMERIC), keep)}) AS _t
              WHERE num_value IS NOT NULL OR str_value IS NOT NULL
              GROUP BY {k}feature, num_value, str_value) AS _c) AS _r
      WHERE rn = 1"""
    if not nums:
        return modes
    stats = _describe_sql(src, nums, keep)
    return (f"SELECT {mk}m.feature, CAST(m.count AS BIGINT) AS count, m.mode_num, m.mode_str, m.mode_n, "
            f"s.mean, s.std, s.min, s.p25, s.p50, s.p75, s.max "
            f"FROM ({modes}) AS m LEFT JOIN ({stats}) AS s ON {on}")


R_COMMON = ("mode_num", "mean", "std", "min", "p25", "p50", "p75", "max")


@query("common_features", _common_sql("clients", ALL_COLS), rnd=R_COMMON)
def q_common_features(spark, sf_dir):
    return X.common_features(clients(spark, sf_dir), ALL_COLS)


@query("top_mode", _common_sql("clients", CATEGORICAL), rnd=("mode_num",))
def q_top_mode(spark, sf_dir):
    return X.common_features(clients(spark, sf_dir), CATEGORICAL)


UNION_CTE = (f"{BANDED_CTE}, grp AS (SELECT * FROM banded UNION ALL "
             f"SELECT * REPLACE (4 AS cluster) FROM banded)")


@query("group_measures", f"WITH {UNION_CTE} " + _common_sql("grp", ALL_COLS, ["cluster"]), rnd=R_COMMON)
def q_group_measures(spark, sf_dir):
    return X.common_features(X.union_groups(banded(spark, sf_dir), "cluster", 4), ALL_COLS, "cluster")


@query("union_frames", f"WITH {UNION_CTE} SELECT cluster, COUNT(*) AS n, CAST(SUM(duration) AS DOUBLE) AS duration "
       "FROM grp GROUP BY cluster", rnd=("duration",))
def q_union_frames(spark, sf_dir):
    u = X.union_groups(banded(spark, sf_dir), "cluster", 4)
    return u.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))


MEASURE_PICKS = [("mode", "job"), ("mode", "contact"), ("mode", "education"),
                 ("mean", "balance"), ("mean", "amount"), ("mean", "duration")]


def _measure_sql() -> str:
    modes = _common_sql("banded", ["job", "contact", "education"], ["cluster"])
    m = (f"SELECT 'mode_' || feature AS measure, cluster, mode_str AS text_value, mode_num AS num_value "
         f"FROM ({modes}) AS _m")
    means = " UNION ALL ".join(
        f"SELECT 'mean_{c}' AS measure, cluster, CAST(NULL AS VARCHAR) AS text_value, AVG(CAST({c} AS DOUBLE)) "
        f"AS num_value FROM banded GROUP BY cluster" for s, c in MEASURE_PICKS if s == "mean")
    return f"WITH {BANDED_CTE} {m} UNION ALL {means}"


@query("measure_table", _measure_sql(), rnd=("num_value",))
def q_measure_table(spark, sf_dir):
    return X.measure_table(banded(spark, sf_dir), "cluster", MEASURE_PICKS)


def _measure_wide_sql() -> str:
    cols = ", ".join(f"MAX(text_value) FILTER (WHERE cluster = {g}) AS text_{g}, "
                     f"MAX(num_value) FILTER (WHERE cluster = {g}) AS num_{g}" for g in (0, 1, 2))
    return f"SELECT measure, {cols} FROM ({_measure_sql()}) AS _m GROUP BY measure"


@query("measure_table_wide", _measure_wide_sql(), rnd=("num_0", "num_1", "num_2"))
def q_measure_table_wide(spark, sf_dir):
    return X.measure_table_wide(banded(spark, sf_dir), "cluster", MEASURE_PICKS, [0, 1, 2])


@query("cluster_centroids", f"WITH {BANDED_CTE} SELECT cluster, AVG(balance) AS balance, AVG(amount) AS amount "
       "FROM banded GROUP BY cluster", rnd=("balance", "amount"))
def q_cluster_centroids(spark, sf_dir):
    return X.centroids(banded(spark, sf_dir), "cluster", ["balance", "amount"])


NEAR_COLS = CATEGORICAL + ["y"]
NEAR_SHARE = 0.6


@query("near_constant",
       f"SELECT feature, mode_num, mode_str, mode_n, count, CAST(mode_n AS DOUBLE) / count AS share "
       f"FROM ({_common_sql('clients', NEAR_COLS)}) AS _c WHERE CAST(mode_n AS DOUBLE) / count >= {NEAR_SHARE}",
       rnd=("mode_num", "share"))
def q_near_constant(spark, sf_dir):
    return X.near_constant(clients(spark, sf_dir), NEAR_COLS, NEAR_SHARE)


# ------------------------------------------------------- 2.6 window and sort

@query("cumulative_share", """
SELECT value, share, SUM(share) OVER (ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       AS cumulative
FROM (SELECT job AS value, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(job) FROM clients) AS share
      FROM clients WHERE job IS NOT NULL GROUP BY job) AS _s""", rnd=("share", "cumulative"))
def q_cumulative_share(spark, sf_dir):
    c = clients(spark, sf_dir)
    vc = X.value_counts(c, ["job"])
    total = c.agg(F.count("job")).scalar()
    s = vc.withColumn("share", F.col("n") / total)
    w = Window.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("value", "share", F.sum("share").over(w).alias("cumulative"))


@query("sort_desc", f"SELECT feature, value, COUNT(*) AS n FROM ({long_sql('clients', CATEGORICAL)}) AS _l "
       "WHERE value IS NOT NULL GROUP BY feature, value ORDER BY n DESC")
def q_sort_desc(spark, sf_dir):
    vc = X.count_by(clients(spark, sf_dir).withColumn("_k", F.lit(1)), CATEGORICAL, "_k").drop("_k")
    return vc.orderBy(F.desc("n"))


# ------------------------------------------------ stored summaries

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
_SUMMED = ["balance", "amount", "duration"]


def _stored_summaries(spark, sf_dir):
    """Summaries of every month, stored and read back."""
    c = clients(spark, sf_dir, ["client_id", "month", *_SUMMED, "education"])
    path = scratch_path(spark, "summaries")
    SM.build(c, ["month"], [*_SUMMED, "education"]).write.parquet(path)
    return c, spark.read.parquet(path)


@query("summary_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, unnest({list(PROBS)}::DOUBLE[]) AS p, unnest(quantile_cont(CAST({c} AS DOUBLE), {list(PROBS)})) AS exact, true AS within FROM clients"
    for c in _SUMMED), rnd=("exact",))
def q_summary_quantiles(spark, sf_dir):
    """Quantiles from two merged halves of the stored months, held against the
    exact ones: is the rank of each within three times the stated error?"""
    c, stored = _stored_summaries(spark, sf_dir)
    halves = SM.merge(stored.withColumn("half", F.col("month").cast("int") % 2), ["half"])
    got = SM.figures(SM.merge(halves), PROBS).where(F.col("quantiles").isNotNull())
    est = got.select("column_name", F.posexplode("quantiles").alias("i", "q")).withColumn("p", F.array(*[F.lit(p) for p in PROBS])[F.col("i")])
    long = c.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("double").alias("x")) for x in _SUMMED])))
    rank = long.join(F.broadcast(est), "column_name").groupBy("column_name", "p").agg(   # one row a column and quantile
        F.avg((F.col("x") < F.col("q")).cast("double")).alias("lo"), F.avg((F.col("x") <= F.col("q")).cast("double")).alias("hi"))
    exact = exact_quantiles(long, ["column_name"], "x", list(PROBS))
    error = 3 * SM.rank_error()
    return exact.join(rank, ["column_name", "p"]).select("column_name", "p", F.col("q").alias("exact"),
                                                         ((F.col("lo") - error <= F.col("p")) & (F.col("p") <= F.col("hi") + error)).alias("within"))


@query("summary_distinct", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct, true AS within FROM clients" for c in [*_SUMMED, "education"]))
def q_summary_distinct(spark, sf_dir):
    """Distinct counts of the merged months, held against the exact ones."""
    c, stored = _stored_summaries(spark, sf_dir)
    got = SM.figures(SM.merge(stored), PROBS).select("column_name", F.col("n_distinct").alias("_est"))
    exact = X.column_figures(c.select(*_SUMMED, "education")).select("column_name", "n_distinct")
    near = F.abs(F.col("_est") - F.col("n_distinct")) <= 2 * SM.distinct_error() * F.col("n_distinct") + 1
    return exact.join(got, "column_name").select("column_name", "n_distinct", near.alias("within"))
