"""Hand-made rows: ties, nulls, gaps, boundaries, zero denominators."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from callsheet.functions.columns import recode
from callsheet.operators import explore as X


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_mode_tie_takes_smallest_and_ignores_null(spark):
    df = rows(spark, [("b", 1), ("a", 2), ("b", 2), ("a", 1), (None, 3), (None, 3), (None, 3)],
              "job string, age int")
    cf = {r["feature"]: r for r in X.common_features(df, ["job", "age"]).collect()}
    assert cf["job"]["mode_str"] == "a" and cf["job"]["mode_n"] == 2 and cf["job"]["count"] == 4
    assert cf["age"]["mode_num"] == 3.0 and cf["age"]["mode_n"] == 3


def test_dense_counts_fill_age_gap_for_both_classes(spark):
    df = rows(spark, [(20, "yes"), (20, "no"), (23, "no")], "age int, y string")
    out = {(r["age"], r["y"]): r["n"] for r in X.dense_counts(df, "age", "y").collect()}
    assert len(out) == 8
    assert out[(21, "yes")] == 0 and out[(22, "no")] == 0 and out[(23, "no")] == 1 and out[(20, "yes")] == 1


def test_cutoff_is_strict_and_null_fails(spark):
    df = rows(spark, [(10000,), (9999,), (None,)], "balance int")
    assert [r[0] for r in X.cutoff(df, {"balance": 10000}).collect()] == [9999]


def test_segment_rate_single_class_group(spark):
    df = rows(spark, [("a", "no"), ("a", "no"), ("b", "yes")], "job string, y string")
    out = {r["value"]: r for r in X.segment_rate(df, ["job"]).collect()}
    assert out["a"]["rate"] == 0.0 and out["b"]["rate"] == 1.0 and out["a"]["n"] == 2


def test_relabel_swap_is_simultaneous(spark):
    df = rows(spark, [(0,), (1,), (2,)], "c int")
    out = dict(df.select("c", recode("c", {2: 1, 1: 2}).alias("r")).collect())
    assert out == {0: 0, 1: 2, 2: 1}


def test_corr_matrix_symmetric_unit_diagonal(spark):
    df = rows(spark, [(1.0, 2.0), (2.0, 4.5), (3.0, 5.5)], "a double, b double")
    out = {(r["a"], r["b"]): r["r"] for r in X.corr_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "a")] == 1.0 and abs(out[("a", "b")] - out[("b", "a")]) < 1e-12


def test_union_groups_adds_total(spark):
    df = rows(spark, [(1,), (1,), (2,)], "cluster int")
    out = {r["cluster"]: r["count"] for r in X.union_groups(df, "cluster", 4).groupBy("cluster").count().collect()}
    assert out == {1: 2, 2: 1, 4: 3}


def test_call_hours_and_tradeoff(spark):
    df = rows(spark, [(1, 1, 3600.0, True), (0, 1, 7200.0, True), (1, 0, 3600.0, False)],
              "label int, prediction int, duration double, kept boolean")
    h = X.call_hours(df, "duration", "prediction", "kept").first()
    assert h["hours_all"] == 4.0 and h["hours_kept"] == 3.0 and h["hours_predicted"] == 3.0
    t = X.tradeoff(df).first()
    assert (t["positives"], t["caught"], t["lost"], t["called"]) == (2, 1, 1, 2)


def test_repartition_invariance(spark):
    from callsheet.sources.clients import CATEGORICAL, clients
    c = clients(spark, "/root/testdata/sf0.001")
    a = sorted(map(tuple, X.segment_rate(c, CATEGORICAL).collect()))
    b = sorted(map(tuple, X.segment_rate(c.repartition(13), CATEGORICAL).collect()))
    assert a == b


def test_column_roles_excludes_label(spark):
    from callsheet.sources.clients import clients
    cats, nums = X.column_roles(clients(spark, "/root/testdata/sf0.001"), "y")
    assert cats == ["job", "contact", "education", "month"]
    assert nums == ["client_id", "balance", "amount", "day", "duration", "campaign"]
