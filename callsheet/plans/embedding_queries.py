"""The same closed-form classifiers and reductions on the wider binding:
``embeddings`` (64-float vectors, 10 integer labels), a multi-class check
of the nearest-centroid and naive-Bayes scoring paths."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.operators import models as MD
from callsheet.operators import prep as P
from callsheet.operators import segments as SG
from callsheet.plans.model_queries import _centroid_cte, _gnb_cte
from callsheet.plans.registry import query
from callsheet.session import materialize, persist
from callsheet.sources.io import load_table

SEED = P.SEED
EMB_DIM = 64          # width of the embedding vectors in the test tables
EMB_COLS = [f"e{i}" for i in range(EMB_DIM)]


def embedding_split(spark, sf_dir) -> DataFrame:
    """One double column per coordinate, exact stratified 50/50 split by label."""
    e = load_table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)]
    df = persist(e.select(F.col("vec_id").alias("client_id"), "label", *cols))
    return materialize(P.split_stratified(df, "label", "client_id", 0.5, SEED), df)


EMB_CTE = ("emb AS (SELECT vec_id AS client_id, label, "
           + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIM))
           + " FROM embeddings), "
           f"erk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(CAST(client_id AS VARCHAR) "
           f"|| '{SEED}'), client_id) AS _rank, COUNT(*) OVER (PARTITION BY label) AS _class_n FROM emb), "
           "esplit AS (SELECT * EXCLUDE (_rank, _class_n), _rank <= round(_class_n * 0.5) AS is_train FROM erk), "
           "ete AS (SELECT * FROM esplit WHERE NOT is_train)")


@query("nearest_centroid_embeddings",
       f"WITH {EMB_CTE}, {_centroid_cte('esplit', EMB_COLS, 'nc', 'ete')} "
       "SELECT client_id AS vec_id, label, prediction FROM nc")
def q_nearest_centroid_embeddings(spark, sf_dir):
    s = embedding_split(spark, sf_dir)
    m = MD.nearest_centroid(s.where("is_train"), EMB_COLS, "label")
    return m.transform(s.where(~F.col("is_train"))).select(F.col("client_id").alias("vec_id"), "label",
                                                           "prediction")


@query("gaussian_nb_embeddings",
       f"WITH {EMB_CTE}, {_gnb_cte('esplit', EMB_COLS, 'nb', 'ete')} "
       "SELECT client_id AS vec_id, label, prediction FROM nb")
def q_gaussian_nb_embeddings(spark, sf_dir):
    s = embedding_split(spark, sf_dir)
    m = MD.gaussian_nb(s.where("is_train"), EMB_COLS, "label")
    return m.transform(s.where(~F.col("is_train"))).select(F.col("client_id").alias("vec_id"), "label",
                                                           "prediction")


def _vectors(spark, sf_dir) -> DataFrame:
    e = load_table(spark, sf_dir, "embeddings")
    return persist(e.select("vec_id", "label", array_to_vector(F.transform("embedding", lambda v: v.cast("double")))
                            .alias("features")))


@query("svd_variance_embeddings")
def q_svd_variance_embeddings(spark, sf_dir):
    return SG.svd_variance(_vectors(spark, sf_dir), "features")


@query("kmeans_embeddings")
def q_kmeans_embeddings(spark, sf_dir):
    out, _ = SG.kmeans(_vectors(spark, sf_dir), "features", 10, SEED)
    return out.select("vec_id", "label", "cluster")
