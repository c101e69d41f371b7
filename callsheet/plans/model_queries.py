"""Preparation, metric and closed-form model queries.

The SQL twins recompute the same fits in plain SQL (class moments,
closed-form scores, argmax with ties to the smaller class), so every step
from the split to the saved call hours is checked by an independent engine.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.functions.columns import binarize, yes_no
from callsheet.operators import explore as X
from callsheet.operators import metrics as M
from callsheet.operators import models as MD
from callsheet.operators import prep as P
from callsheet.plans.registry import query
from callsheet.session import materialize, persist, spread
from callsheet.sources.clients import CATEGORICAL, NUMERIC, clients, indicator_names, indicators_sql, level_features, with_indicators

SEED = P.SEED
# Fixed values (the notebooks' settings): 50/50 split, trim at P(no) >= 0.99
FRAC = 0.5
# Both layers fit on the encoded table: z-scored numerics and a 0/1 column per
# level. The first layer does without the call columns (day, month, duration, campaign).
L1_NUMERIC = ["balance", "amount"]
L1_CATEGORICAL = ["job", "contact", "education"]
L1_FEATURES = L1_NUMERIC + indicator_names(L1_CATEGORICAL)
L2_FEATURES = list(NUMERIC) + indicator_names(CATEGORICAL)
TRIM_P = 0.99
SECONDS_PER_HOUR = 3600.0

# ------------------------------------------------------------ Spark frames


def labeled(spark, sf_dir, columns=None) -> DataFrame:
    """Clients (all or the named columns) with label and split flag. The
    cuts are found on id and label alone, so only orders is read for them;
    the flag is then an expression on each row."""
    keys = P.split_expression(clients(spark, sf_dir, ["client_id", "y"]).withColumn("label", yes_no("y")),
                              "label", "client_id", FRAC, SEED)
    columns = columns if columns is None else [*columns, "client_id", "y"]
    return keys(clients(spark, sf_dir, columns).withColumn("label", yes_no("y")))


def scaled(spark, sf_dir, numeric=NUMERIC) -> DataFrame:
    """Numerics z-scored with train mean / population std and the indicator
    columns; raw duration kept."""
    n = clients(spark, sf_dir, ["client_id"]).count()
    lab = persist(spread(labeled(spark, sf_dir), "client_id", n)).withColumn("raw_duration", F.col("duration"))
    stats = P.fit_standardize(lab.where("is_train"), numeric)
    return with_indicators(P.apply_standardize(lab, stats))


# --------------------------------------------------------------- SQL text

SPLIT_CTE = f"""
lab AS (SELECT *, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label FROM clients),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(client_id AS VARCHAR) || '{SEED}'),
                                    client_id) AS _rank,
              COUNT(*) OVER (PARTITION BY label) AS _class_n FROM lab),
split AS (SELECT * EXCLUDE (_rank, _class_n), _rank <= round(_class_n * {FRAC}) AS is_train,
                 CAST((_rank > (_class_n * 1) // 5) AS INTEGER) + CAST((_rank > (_class_n * 2) // 5) AS INTEGER)
                 + CAST((_rank > (_class_n * 3) // 5) AS INTEGER) + CAST((_rank > (_class_n * 4) // 5) AS INTEGER)
                 AS fold FROM rk)"""


def _scaled_cte(src: str = "split", name: str = "sc", features=NUMERIC) -> str:
    st = ", ".join(f"AVG({f}) AS m_{f}, STDDEV_POP({f}) AS s_{f}" for f in features)
    z = ", ".join(f"(CAST(t.{f} AS DOUBLE) - st.m_{f}) / CASE WHEN st.s_{f} > 0 THEN st.s_{f} ELSE 1 END AS {f}"
                  for f in features)
    return (f"{name}_st AS (SELECT {st} FROM {src} WHERE is_train), "
            f"{name} AS (SELECT t.* REPLACE ({z}), t.duration AS raw_duration, {indicators_sql()} FROM {src} t, {name}_st st)")


def _argmax_sql(scores: str, name: str, prob: bool) -> str:
    """From (client_id, label, c, s) rows pick the best class per client."""
    p = (", SUM(CASE WHEN c = 0 THEN exp(s - mx) ELSE 0 END) / SUM(exp(s - mx)) AS prob0" if prob else "")
    return (f"{name} AS (SELECT client_id, label, FIRST(c ORDER BY s DESC, c) AS prediction{p} "
            f"FROM (SELECT *, MAX(s) OVER (PARTITION BY client_id) AS mx FROM {scores}) AS _x "
            f"GROUP BY client_id, label)")


def _gnb_cte(src: str, features, name: str, target: str) -> str:
    """Gaussian NB fitted on ``src`` train rows, scored on ``target`` rows."""
    m = ", ".join(f"AVG({f}) AS m_{f}, VAR_POP({f}) AS v_{f}" for f in features)
    eps = "GREATEST(" + ", ".join(f"VAR_POP({f})" for f in features) + ")" if len(features) > 1 \
        else f"VAR_POP({features[0]})"
    logdet = " + ".join(f"ln(2 * pi() * (k.v_{f} + e.e))" for f in features)
    quad = " + ".join(f"pow(t.{f} - k.m_{f}, 2) / (k.v_{f} + e.e)" for f in features)
    return (f"{name}_k AS (SELECT label AS c, COUNT(*) AS n, {m} FROM {src} WHERE is_train GROUP BY label), "
            f"{name}_e AS (SELECT 1e-9 * {eps} AS e FROM {src} WHERE is_train), "
            f"{name}_s AS (SELECT t.client_id, t.label, k.c, ln(k.n / (SELECT SUM(n) FROM {name}_k)) "
            f"- 0.5 * ({logdet}) - 0.5 * ({quad}) AS s FROM {target} t, {name}_k k, {name}_e e), "
            + _argmax_sql(f"{name}_s", name, True))


def _centroid_cte(src: str, features, name: str, target: str, metric: str = "euclidean") -> str:
    agg = "AVG" if metric == "euclidean" else "MEDIAN"
    m = ", ".join(f"{agg}({f}) AS m_{f}" for f in features)
    if metric == "euclidean":
        dist = " + ".join(f"pow(t.{f} - k.m_{f}, 2)" for f in features)
    else:
        dist = " + ".join(f"abs(t.{f} - k.m_{f})" for f in features)
    return (f"{name}_k AS (SELECT label AS c, {m} FROM {src} WHERE is_train GROUP BY label), "
            f"{name}_s AS (SELECT t.client_id, t.label, k.c, -({dist}) AS s FROM {target} t, {name}_k k), "
            + _argmax_sql(f"{name}_s", name, False))


def _qda1_cte(src: str, features, name: str, target: str) -> str:
    m = ", ".join(f"AVG({f}) AS m_{f}" for f in features)
    quad = " + ".join(f"pow(t.{f} - k.m_{f}, 2)" for f in features)
    return (f"{name}_k AS (SELECT label AS c, COUNT(*) AS n, {m} FROM {src} WHERE is_train GROUP BY label), "
            f"{name}_s AS (SELECT t.client_id, t.label, k.c, ln(k.n / (SELECT SUM(n) FROM {name}_k)) "
            f"- 0.5 * ({quad}) AS s FROM {target} t, {name}_k k), "
            + _argmax_sql(f"{name}_s", name, True))


TEST_CTE = "te AS (SELECT * FROM sc WHERE NOT is_train)"
BASE = f"WITH {SPLIT_CTE}, {_scaled_cte()}, {TEST_CTE}"

# ------------------------------------------------------------- 2.7 prep


@query("split_stratified", f"WITH {SPLIT_CTE} SELECT client_id, label, is_train FROM split")
def q_split(spark, sf_dir):
    return labeled(spark, sf_dir, []).select("client_id", "label", "is_train")


@query("stratified_folds", f"WITH {SPLIT_CTE} SELECT client_id, label, fold FROM split")
def q_folds(spark, sf_dir):
    c = clients(spark, sf_dir, ["client_id", "y"]).withColumn("label", yes_no("y"))
    return P.stratified_folds(c, "label", "client_id", 5, SEED).select("client_id", "label", "fold")


@query("standardize", f"WITH {SPLIT_CTE}, {_scaled_cte()} SELECT client_id, {', '.join(NUMERIC)} FROM sc",
       rnd=tuple(NUMERIC))
def q_standardize(spark, sf_dir):
    lab = labeled(spark, sf_dir, NUMERIC)
    return P.apply_standardize(lab, P.fit_standardize(lab.where("is_train"), NUMERIC)).select("client_id", *NUMERIC)


def _impute_sql() -> str:
    fills = []
    for c in ["job", "contact", "education"]:
        fills.append(f"COALESCE({c}, (SELECT {c} FROM split WHERE is_train AND {c} IS NOT NULL "
                     f"GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}")
    return f"WITH {SPLIT_CTE} SELECT client_id, {', '.join(fills)} FROM split"


@query("impute_mode", _impute_sql())
def q_impute_mode(spark, sf_dir):
    cols = ["job", "contact", "education"]
    lab = labeled(spark, sf_dir, cols)
    return P.impute_mode(lab, cols, lab.where("is_train")).select("client_id", *cols)


# every k-th id loses its value
HOLES = {"job": 3, "contact": 5, "education": 7}


def _impute_nulls_sql() -> str:
    holes = ", ".join(f"CASE WHEN client_id % {k} = 0 THEN NULL ELSE {c} END AS {c}" for c, k in HOLES.items())
    return _impute_sql().replace("FROM split", "FROM holed").replace("SELECT client_id,", f", holed AS (SELECT * REPLACE ({holes}) FROM split) SELECT client_id,", 1)


@query("impute_mode_nulls", _impute_nulls_sql())
def q_impute_mode_nulls(spark, sf_dir):
    """The fill over columns that do have nulls."""
    cols = list(HOLES)
    lab = labeled(spark, sf_dir, cols).withColumns({c: F.when(F.col("client_id") % k != 0, F.col(c)) for c, k in HOLES.items()})
    return P.impute_mode(lab, cols, lab.where("is_train")).select("client_id", *cols)


def _hot_sql(drop_first: bool = False) -> str:
    sel, joins = [], []
    for i, c in enumerate(CATEGORICAL if not drop_first else ["job"]):
        cats = (f"(SELECT {c} AS v, CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS INTEGER) AS r, "
                f"COUNT(*) OVER () AS L FROM (SELECT DISTINCT {c} FROM split WHERE is_train AND {c} IS NOT NULL)"
                f" AS _d)")
        joins.append(f"LEFT JOIN {cats} AS h{i} ON s.{c} = h{i}.v")
        if drop_first:
            sel.append(f"CAST(CASE WHEN h{i}.r IS NULL OR h{i}.r = 0 THEN -1 ELSE h{i}.L - 1 - h{i}.r END "
                       f"AS INTEGER) AS {c}_hot")
        else:
            sel.append(f"COALESCE(h{i}.r, -1) AS {c}_hot")
    return f"WITH {SPLIT_CTE} SELECT s.client_id, {', '.join(sel)} FROM split s {' '.join(joins)}"


def _hot_position(c: str) -> F.Column:
    return (F.array_position(vector_to_array(F.col(c)), 1.0) - 1).cast("int")


@query("one_hot", _hot_sql())
def q_one_hot(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    out = P.one_hot(lab.where("is_train"), CATEGORICAL, lab)
    return out.select("client_id", *[_hot_position(f"{c}_oh").alias(f"{c}_hot") for c in CATEGORICAL])


@query("dummies_drop_first", _hot_sql(drop_first=True))
def q_dummies(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    out = P.dummies(lab.where("is_train"), "job", lab)
    return out.select("client_id", _hot_position("job_dummies").alias("job_hot"))


def _prep(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    prep = P.FeaturePrep(NUMERIC, CATEGORICAL).fit(lab.where("is_train"))
    return lab, prep


def _slots_sql(rows: str) -> str:
    """(client_id, label, slot, value): the assembled vector's slots that are
    not 0: z-scores (sample deviation), then the levels seen in training by name."""
    fill = ", ".join(f"COALESCE({c}, (SELECT {c} FROM split WHERE is_train AND {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}"
                     for c in CATEGORICAL)
    st = ", ".join(f"AVG({f}) AS m_{f}, STDDEV_SAMP({f}) AS s_{f}" for f in NUMERIC)
    num = " UNION ALL ".join(f"SELECT client_id, label, {i} AS slot, CASE WHEN s_{f} > 0 THEN (CAST({f} AS DOUBLE) - m_{f}) / s_{f} ELSE 0 END AS value "
                             f"FROM filled, st WHERE {rows}" for i, f in enumerate(NUMERIC))
    levels = " UNION ALL ".join(f"SELECT DISTINCT {i} AS c, {c} AS v FROM filled WHERE is_train" for i, c in enumerate(CATEGORICAL))
    cat = " UNION ALL ".join(f"SELECT client_id, label, slot, 1.0 AS value FROM filled JOIN place ON c = {i} AND v = {c} WHERE {rows}" for i, c in enumerate(CATEGORICAL))
    return f"""WITH {SPLIT_CTE}, filled AS (SELECT * REPLACE ({fill}) FROM split), st AS (SELECT {st} FROM filled WHERE is_train),
    place AS (SELECT c, v, {len(NUMERIC) - 1} + ROW_NUMBER() OVER (ORDER BY c, v) AS slot FROM ({levels}) AS _l WHERE v IS NOT NULL),
    slots AS ({num} UNION ALL {cat})
    SELECT client_id, label, CAST(slot AS INTEGER) AS slot, value FROM slots WHERE round(value, 6) <> 0"""


def _slots(df: DataFrame) -> DataFrame:
    out = df.select("client_id", "label", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return out.where(F.round("value", 6) != 0)


@query("feature_pipeline", _slots_sql("is_train"), rnd=("value",))
def q_feature_pipeline(spark, sf_dir):
    """The fitted encoding of the training rows, slot by slot."""
    lab, prep = _prep(spark, sf_dir)
    return _slots(prep.transform(lab.where("is_train"), ["client_id", "label"]))


@query("transform_with_train", _slots_sql("NOT is_train"), rnd=("value",))
def q_transform_with_train(spark, sf_dir):
    """The other rows, encoded as fitted on the training rows."""
    lab, prep = _prep(spark, sf_dir)
    return _slots(prep.transform(lab.where(~F.col("is_train")), ["client_id", "label"]))


# ------------------------------------------------------ 2.8 closed forms


def gnb_predictions(spark, sf_dir, features=L2_FEATURES) -> DataFrame:
    sc = scaled(spark, sf_dir)
    model = MD.gaussian_nb(sc.where("is_train"), features, "label", 1e-9)
    return model.transform(sc.where(~F.col("is_train")))


def _out(df: DataFrame, prob: bool = True) -> DataFrame:
    cols = ["client_id", "label", "prediction"]
    if prob:
        return df.select(*cols, F.col("probability")[0].alias("prob0"))
    return df.select(*cols)


@query("gaussian_nb", f"{BASE}, {_gnb_cte('sc', L2_FEATURES, 'nb', 'te')} SELECT * FROM nb", rnd=("prob0",))
def q_gaussian_nb(spark, sf_dir):
    return _out(gnb_predictions(spark, sf_dir))


@query("nearest_centroid", f"{BASE}, {_centroid_cte('sc', L2_FEATURES, 'nc', 'te')} SELECT * FROM nc")
def q_nearest_centroid(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    m = MD.nearest_centroid(sc.where("is_train"), L2_FEATURES, "label")
    return _out(m.transform(sc.where(~F.col("is_train"))), prob=False)


@query("nearest_centroid_manhattan",
       f"{BASE}, {_centroid_cte('sc', L2_FEATURES, 'nc', 'te', 'manhattan')} SELECT * FROM nc")
def q_nearest_centroid_manhattan(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    m = MD.nearest_centroid(sc.where("is_train"), L2_FEATURES, "label", metric="manhattan")
    return _out(m.transform(sc.where(~F.col("is_train"))), prob=False)


@query("assign_nearest", f"WITH {SPLIT_CTE}, {_scaled_cte()}, "
       f"{_centroid_cte('sc', L2_FEATURES, 'nc', 'sc')} SELECT client_id, prediction AS cluster FROM nc")
def q_assign_nearest(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    m = MD.nearest_centroid(sc.where("is_train"), L2_FEATURES, "label")
    return m.transform(sc, "cluster").select("client_id", "cluster")


@query("qda", f"{BASE}, {_qda1_cte('sc', L2_FEATURES, 'qd', 'te')} SELECT * FROM qd", rnd=("prob0",))
def q_qda(spark, sf_dir):
    sc = scaled(spark, sf_dir)
    m = MD.qda(sc.where("is_train"), L2_FEATURES, "label", reg_param=1.0)
    return _out(m.transform(sc.where(~F.col("is_train"))))


VOTE_SQL = (f"{BASE}, {_gnb_cte('sc', L2_FEATURES, 'nb', 'te')}, {_centroid_cte('sc', L2_FEATURES, 'nc', 'te')}, "
            f"{_qda1_cte('sc', L2_FEATURES, 'qd', 'te')} "
            "SELECT nb.client_id, nb.label, nb.prediction AS p_nb, nc.prediction AS p_nc, qd.prediction AS p_qda, "
            "CAST(nb.prediction + nc.prediction + qd.prediction > 1.5 AS INTEGER) AS prediction "
            "FROM nb JOIN nc ON nb.client_id = nc.client_id JOIN qd ON nb.client_id = qd.client_id")


def voted(spark, sf_dir) -> DataFrame:
    """Three closed-form models scored side by side on one row (no joins)."""
    sc = scaled(spark, sf_dir)
    train, test = sc.where("is_train"), sc.where(~F.col("is_train"))
    nb = MD.gaussian_nb(train, L2_FEATURES, "label")
    nc = MD.nearest_centroid(train, L2_FEATURES, "label")
    qd = MD.qda(train, L2_FEATURES, "label", 1.0)
    t = nb.transform(test, "p_nb", "_p1")
    t = nc.transform(t, "p_nc")
    t = qd.transform(t, "p_qda", "_p2")
    return MD.vote(t, ["p_nb", "p_nc", "p_qda"])


@query("voting_hard", VOTE_SQL)
def q_voting_hard(spark, sf_dir):
    return voted(spark, sf_dir).select("client_id", "label", "p_nb", "p_nc", "p_qda", "prediction")


@query("dummy_majority", f"WITH {SPLIT_CTE}, maj AS (SELECT label AS c FROM split WHERE is_train GROUP BY label "
       "ORDER BY COUNT(*) DESC, label LIMIT 1) SELECT client_id, label, (SELECT c FROM maj) AS prediction "
       "FROM split WHERE NOT is_train")
def q_dummy_majority(spark, sf_dir):
    lab = labeled(spark, sf_dir)
    c = MD.majority(lab.where("is_train"))
    return lab.where(~F.col("is_train")).select("client_id", "label", F.lit(c).cast("int").alias("prediction"))


# ---------------------------------------------------------- 2.5 metrics
# Metrics run on two prediction frames: the three-model vote (checked end to
# end above) and rule scores binarised at 0.5.

RULES = {"rule_balance": "(balance + 1000.0) / 11000.0", "rule_amount": "amount / 500000.0",
         "rule_duration": "duration / 200.0"}
RULES_SQL = " UNION ALL ".join(
    f"SELECT client_id, '{k}' AS model, CASE WHEN y = 'yes' THEN 1 ELSE 0 END AS label, {v} AS score, "
    f"CAST({v} >= 0.5 AS INTEGER) AS prediction FROM clients" for k, v in RULES.items())


def rule_predictions(spark, sf_dir) -> DataFrame:
    """(client_id, model, label, score, prediction) for three score rules,
    produced by one scan (one output row per rule per client)."""
    c = clients(spark, sf_dir)
    rows = [F.struct(F.lit(k).alias("model"), F.expr(v).cast("double").alias("score")) for k, v in RULES.items()]
    long = c.select("client_id", yes_no("y").alias("label"), F.inline(F.array(*rows)))
    return long.withColumn("prediction", binarize("score", 0.5))


@query("binarize", f"SELECT client_id, model, label, prediction FROM ({RULES_SQL}) AS _r")
def q_binarize(spark, sf_dir):
    return rule_predictions(spark, sf_dir).select("client_id", "model", "label", "prediction")


CONF_SQL = ("SELECT model, CAST(SUM(CASE WHEN label <> 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
            "CAST(SUM(CASE WHEN label <> 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
            "CAST(SUM(CASE WHEN label = 1 AND prediction <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
            "CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp "
            "FROM ({src}) AS _p GROUP BY model")


@query("confusion_matrix", CONF_SQL.format(src=RULES_SQL))
def q_confusion_matrix(spark, sf_dir):
    return M.confusion(rule_predictions(spark, sf_dir), by="model")


def _ratios_sql(src: str) -> str:
    def r(a, b):
        return f"CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({a} + {b}) END"
    return (f"SELECT model, {r('tp', 'fn')} AS tp, {r('tn', 'fp')} AS tn, {r('fp', 'tn')} AS fp, "
            f"{r('fn', 'tp')} AS fn FROM ({CONF_SQL.format(src=src)}) AS _c ORDER BY tp DESC")


@query("confusion_ratios", _ratios_sql(RULES_SQL), rnd=("tp", "tn", "fp", "fn"))
def q_confusion_ratios(spark, sf_dir):
    return M.confusion_ratios(rule_predictions(spark, sf_dir), by="model")


VOTE_LONG_SQL = (f"SELECT client_id, 'nb' AS model, label, p_nb AS prediction FROM ({VOTE_SQL}) AS _v1 UNION ALL "
                 f"SELECT client_id, 'nc' AS model, label, p_nc AS prediction FROM ({VOTE_SQL}) AS _v2 UNION ALL "
                 f"SELECT client_id, 'qda' AS model, label, p_qda AS prediction FROM ({VOTE_SQL}) AS _v3 UNION ALL "
                 f"SELECT client_id, 'vote' AS model, label, prediction FROM ({VOTE_SQL}) AS _v4")


def vote_long(spark, sf_dir) -> DataFrame:
    v = voted(spark, sf_dir)
    rows = [F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction"))
            for m, c in (("nb", "p_nb"), ("nc", "p_nc"), ("qda", "p_qda"), ("vote", "prediction"))]
    return v.select("client_id", "label", F.inline(F.array(*rows)))


@query("confusion_ratios_models", _ratios_sql(VOTE_LONG_SQL), rnd=("tp", "tn", "fp", "fn"))
def q_confusion_ratios_models(spark, sf_dir):
    return M.confusion_ratios(vote_long(spark, sf_dir), by="model")


@query("accuracy", "SELECT model, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy "
       f"FROM ({RULES_SQL}) AS _r GROUP BY model", rnd=("accuracy",))
def q_accuracy(spark, sf_dir):
    return M.accuracy(rule_predictions(spark, sf_dir), by="model")


def _prf_sql(src: str) -> str:
    p = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END"
    r = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END"
    return (f"SELECT model, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 "
            f"ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM "
            f"(SELECT model, {p} AS precision, {r} AS recall FROM ({CONF_SQL.format(src=src)}) AS _c) AS _s")


@query("recall_score", f"SELECT model, recall FROM ({_prf_sql(RULES_SQL)}) AS _f", rnd=("recall",))
def q_recall(spark, sf_dir):
    return M.recall(rule_predictions(spark, sf_dir), by="model")


@query("f1_score", f"SELECT model, f1 FROM ({_prf_sql(RULES_SQL)}) AS _f", rnd=("f1",))
def q_f1(spark, sf_dir):
    return M.f1(rule_predictions(spark, sf_dir), by="model")


REPORT_SQL = f"""
WITH {SPLIT_CTE}, {_scaled_cte()}, {TEST_CTE}, {_gnb_cte('sc', L2_FEATURES, 'nb', 'te')},
pairs AS (SELECT label, prediction, COUNT(*) AS n FROM nb GROUP BY label, prediction),
cl AS (SELECT label AS c FROM pairs UNION SELECT prediction FROM pairs),
pc AS (SELECT cl.c,
         COALESCE((SELECT SUM(n) FROM pairs WHERE label = cl.c), 0) AS support,
         COALESCE((SELECT SUM(n) FROM pairs WHERE label = cl.c AND prediction = cl.c), 0) AS tp,
         COALESCE((SELECT SUM(n) FROM pairs WHERE prediction = cl.c), 0) AS pn FROM cl),
m AS (SELECT c, CASE WHEN pn = 0 THEN 0.0 ELSE tp / pn END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM pc),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END
             AS f1 FROM m)
SELECT CAST(c AS VARCHAR) AS row, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END),
                 COUNT(*) FROM nb
UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
                 SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM f
"""


@query("classification_report", REPORT_SQL, rnd=("precision", "recall", "f1"))
def q_classification_report(spark, sf_dir):
    return M.classification_report(gnb_predictions(spark, sf_dir))


@query("balanced_accuracy", "SELECT model, AVG(r) AS balanced_accuracy FROM (SELECT model, label, "
       "AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS r FROM "
       f"({VOTE_LONG_SQL}) AS _v GROUP BY model, label) AS _r GROUP BY model", rnd=("balanced_accuracy",))
def q_balanced_accuracy(spark, sf_dir):
    return M.balanced_accuracy(vote_long(spark, sf_dir), by="model")


# -------------------------------------------- trimming and the two layers

TWO_LAYER_CTE = f"""
{SPLIT_CTE}, {_scaled_cte('split', 'sc1', L1_NUMERIC)},
{_gnb_cte('sc1', L1_FEATURES, 'l1', 'sc1')},
trimmed AS (SELECT s.* EXCLUDE (is_train, fold) FROM split s JOIN l1 ON s.client_id = l1.client_id
            WHERE l1.prob0 < {TRIM_P}),
rk2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(client_id AS VARCHAR) || '{SEED}'),
                                     client_id) AS _rank,
               COUNT(*) OVER (PARTITION BY label) AS _class_n FROM trimmed),
split2 AS (SELECT * EXCLUDE (_rank, _class_n), _rank <= round(_class_n * {FRAC}) AS is_train FROM rk2),
{_scaled_cte('split2', 'sc2')},
{_centroid_cte('sc2', L2_FEATURES, 'l2', 'sc2')},
layer AS (SELECT l2.client_id, l2.label, l2.prediction, sc2.raw_duration AS duration
          FROM l2 JOIN sc2 ON l2.client_id = sc2.client_id)"""


def trimmed(spark, sf_dir, level: float = TRIM_P) -> DataFrame:
    """Layer 1: Gaussian NB without the call columns; keep rows whose
    P(no) is below the trim level (the rest are not worth a call)."""
    lab = persist(labeled(spark, sf_dir))
    stats = P.fit_standardize(lab.where("is_train"), L1_NUMERIC)
    sc1 = P.apply_standardize(lab, stats, suffix="_z")
    z = [*[f"{f}_z" for f in L1_NUMERIC], *level_features(L1_CATEGORICAL)]
    nb = MD.gaussian_nb(sc1.where("is_train"), z, "label")
    return sc1.where(nb.probability(0) < level).select(*[c for c in lab.columns if c != "is_train"])


def two_layer(spark, sf_dir) -> DataFrame:
    """Layer 2: re-split the kept rows, nearest centroid on all numerics,
    predict every kept row. Returns (client_id, label, prediction, duration)."""
    t = persist(trimmed(spark, sf_dir))
    t2 = materialize(P.split_stratified(t, "label", "client_id", FRAC, SEED), t)
    stats = P.fit_standardize(t2.where("is_train"), NUMERIC)
    sc2 = P.apply_standardize(t2.withColumn("raw_duration", F.col("duration")), stats)
    nc = MD.nearest_centroid(sc2.where("is_train"), [*NUMERIC, *level_features(CATEGORICAL)], "label")
    return nc.transform(sc2).select("client_id", "label", "prediction",
                                    F.col("raw_duration").alias("duration"))


@query("filter_probability", f"WITH {TWO_LAYER_CTE} SELECT client_id, label FROM trimmed")
def q_filter_probability(spark, sf_dir):
    return trimmed(spark, sf_dir).select("client_id", "label")


MIDDLE_P = 0.67


@query("filter_probability_middle", f"WITH {TWO_LAYER_CTE} SELECT client_id, label FROM trimmed".replace(f"l1.prob0 < {TRIM_P}", f"l1.prob0 < {MIDDLE_P}"))
def q_filter_probability_middle(spark, sf_dir):
    """A trim level inside the range of the scores: some rows go, some stay."""
    return trimmed(spark, sf_dir, MIDDLE_P).select("client_id", "label")


@query("two_layer", f"WITH {TWO_LAYER_CTE} SELECT client_id, label, prediction FROM layer")
def q_two_layer(spark, sf_dir):
    return two_layer(spark, sf_dir).select("client_id", "label", "prediction")


@query("filter_predicted", f"WITH {TWO_LAYER_CTE} SELECT client_id FROM layer WHERE prediction = 1")
def q_filter_predicted(spark, sf_dir):
    return two_layer(spark, sf_dir).where(F.col("prediction") == 1).select("client_id")


@query("attach_labels", f"WITH {TWO_LAYER_CTE} SELECT c.client_id, c.job, c.education, c.y, l.prediction "
       "FROM clients c JOIN layer l ON c.client_id = l.client_id")
def q_attach_labels(spark, sf_dir):
    pred = two_layer(spark, sf_dir).select("client_id", "prediction")
    return clients(spark, sf_dir).select("client_id", "job", "education", "y").join(pred, "client_id")


H = SECONDS_PER_HOUR


@query("call_hours", f"WITH {TWO_LAYER_CTE}, hk AS (SELECT SUM(duration) AS k, "
       f"SUM(CASE WHEN prediction = 1 THEN duration ELSE 0 END) AS p FROM layer), "
       f"ha AS (SELECT SUM(duration) AS a FROM clients) "
       f"SELECT ha.a / {H} AS hours_all, hk.k / {H} AS hours_kept, hk.p / {H} AS hours_predicted, "
       f"(ha.a - hk.k) / {H} AS saved_by_trim, (ha.a - hk.p) / {H} AS saved_by_model FROM ha, hk",
       rnd=("hours_all", "hours_kept", "hours_predicted", "saved_by_trim", "saved_by_model"))
def q_call_hours(spark, sf_dir):
    layer = two_layer(spark, sf_dir).withColumn("kept", F.lit(True))
    everyone = clients(spark, sf_dir).select("client_id", "duration")
    # every client once; kept rows carry the layer-2 prediction
    j = everyone.join(layer.select("client_id", "kept", "prediction"), "client_id", "left").fillna(
        {"kept": False, "prediction": 0})
    return X.call_hours(j, "duration", "prediction", "kept", SECONDS_PER_HOUR)


@query("tradeoff", f"WITH {TWO_LAYER_CTE} SELECT CAST(SUM(label) AS BIGINT) AS positives, "
       "CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS caught, "
       "CAST(SUM(label) - SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS lost, "
       "CAST(SUM(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS called, "
       f"SUM(CASE WHEN prediction = 1 THEN duration ELSE 0 END) / {H} AS hours_called FROM layer",
       rnd=("hours_called",))
def q_tradeoff(spark, sf_dir):
    return X.tradeoff(two_layer(spark, sf_dir), "label", "prediction", "duration", SECONDS_PER_HOUR)
