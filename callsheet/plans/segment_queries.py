"""Segmentation of the positive class: SVD, PCA, k-means and
its elbow, Gower distances to landmarks, bisecting k-means, DBSCAN and the
profile tables per segment."""

from __future__ import annotations

from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsheet.operators import dbscan as D
from callsheet.operators import explore as X
from callsheet.operators import gower as G
from callsheet.operators import metric_dbscan as MDB
from callsheet.operators import prep as P
from callsheet.operators import segments as SG
from callsheet.operators import wide_svd as WS
from callsheet.plans.registry import query
from callsheet.session import persist, spread
from callsheet.sources.clients import CATEGORICAL, NUMERIC, clients

# Fixed values (the notebooks' settings): seed, 22 SVD components, k-means k = 3 on the
# embedding and 5 on the Gower rows, DBSCAN eps 0.3 with 25 points (self included)
SEED = 6932
SVD_K = 22
KMEANS_K = 3
GOWER_K = 5
N_LANDMARKS = 32
DBSCAN_EPS = 0.3
DBSCAN_MIN = 25
PROFILE_PICKS = [("mode", "job"), ("mode", "contact"), ("mode", "education"),
                 ("mean", "balance"), ("mean", "amount"), ("mean", "duration")]


def subscribers(spark, sf_dir) -> DataFrame:
    """The positive class with the label dropped (the segmentation input)."""
    n = clients(spark, sf_dir, ["client_id", "y"]).where(F.col("y") == "yes").count()
    return spread(clients(spark, sf_dir).where(F.col("y") == "yes").drop("y"), "client_id", n)


def encoded(spark, sf_dir) -> DataFrame:
    subs = persist(subscribers(spark, sf_dir))
    prep = P.FeaturePrep(NUMERIC, CATEGORICAL).fit(subs)
    return persist(prep.transform(subs))


def embedded(spark, sf_dir) -> DataFrame:
    """SVD(22) -> PCA(2) embedding of the encoded subscribers, with x / y."""
    enc = encoded(spark, sf_dir)
    svd = SG.svd_project(enc, "features", SVD_K, "svd")
    pca, _ = SG.pca_project(svd, "svd", 2, "pca")
    return persist(pca.withColumnRenamed("pc1", "x").withColumnRenamed("pc2", "y"))


def segmented(spark, sf_dir) -> DataFrame:
    emb = embedded(spark, sf_dir)
    labelled, _ = SG.kmeans(emb, "pca", KMEANS_K, SEED, "cluster")
    return labelled


@query("svd_variance")
def q_svd_variance(spark, sf_dir):
    return SG.svd_variance(encoded(spark, sf_dir), "features")


# levels of all pairs of categoricals and bands of the numerics, hashed into so many features
HASHED = 1 << 16


@query("svd_variance_hashed")
def q_svd_variance_hashed(spark, sf_dir):
    """Variance of a wide sparse table: pairs of levels hashed into 65,536 features."""
    subs = subscribers(spark, sf_dir)
    pairs = [F.concat_ws("|", a, b).alias(f"{a}_{b}") for i, a in enumerate(CATEGORICAL) for b in CATEGORICAL[:i]]
    bands = [F.concat_ws("|", F.lit(c), F.floor(F.col(c) / w).cast("string")).alias(c) for c, w in (("balance", 500), ("amount", 5000), ("duration", 5))]
    names = [*[f"{a}_{b}" for i, a in enumerate(CATEGORICAL) for b in CATEGORICAL[:i]], "balance", "amount", "duration"]
    hashed = FeatureHasher(inputCols=names, outputCol="features", numFeatures=HASHED, categoricalCols=names).transform(subs.select(*pairs, *bands))
    return WS.wide_variance(hashed, "features", SVD_K, HASHED, seed=SEED)


@query("svd_project")
def q_svd_project(spark, sf_dir):
    p = SG.svd_project(encoded(spark, sf_dir), "features", SVD_K, "svd")
    return p.select("client_id", vector_to_array("svd").alias("svd"))


@query("pca_project")
def q_pca_project(spark, sf_dir):
    return embedded(spark, sf_dir).select("client_id", "x", "y")


@query("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    return segmented(spark, sf_dir).select("client_id", "cluster")


@query("kmeans_elbow")
def q_kmeans_elbow(spark, sf_dir):
    return SG.elbow(embedded(spark, sf_dir), "pca", 1, 9, SEED)


@query("crosstab_kmeans")
def q_crosstab_kmeans(spark, sf_dir):
    return X.crosstab(segmented(spark, sf_dir), CATEGORICAL, "cluster", list(range(KMEANS_K)))


@query("distribution_kmeans")
def q_distribution_kmeans(spark, sf_dir):
    return X.distribution(segmented(spark, sf_dir), NUMERIC, "cluster", {"balance": 10000, "duration": 2000,
                                                                        "campaign": 10})


@query("embedding_centroids")
def q_embedding_centroids(spark, sf_dir):
    return X.centroids(segmented(spark, sf_dir), "cluster", ["x", "y"])


@query("profile_kmeans")
def q_profile_kmeans(spark, sf_dir):
    seg = X.union_groups(segmented(spark, sf_dir), "cluster", KMEANS_K + 1)
    return X.measure_table(seg, "cluster", PROFILE_PICKS)


def _gower_sql() -> str:
    num = ["balance", "amount", "day", "duration", "campaign"]
    cat = ["job", "contact", "education", "month"]
    rng = ", ".join(f"MAX({c}) - MIN({c}) AS r_{c}" for c in num)
    terms = [f"CASE WHEN r.r_{c} = 0 THEN 0.0 ELSE abs(s.{c} - l.{c}) / r.r_{c} END" for c in num]
    terms += [f"CASE WHEN s.{c} = l.{c} THEN 0.0 ELSE 1.0 END" for c in cat]
    return f"""
    WITH subs AS (SELECT * FROM clients WHERE y = 'yes'),
    lm AS (SELECT * FROM subs ORDER BY md5(CAST(client_id AS VARCHAR) || '{SEED}'), client_id LIMIT {N_LANDMARKS}),
    r AS (SELECT {rng} FROM subs)
    SELECT s.client_id AS id_a, l.client_id AS landmark, ({' + '.join(terms)}) / {len(terms)} AS d
    FROM subs s, lm l, r"""


@query("gower_to_landmarks", _gower_sql(), rnd=("d",))
def q_gower_to_landmarks(spark, sf_dir):
    return G.gower_to_landmarks(subscribers(spark, sf_dir), "client_id", NUMERIC, CATEGORICAL, N_LANDMARKS, SEED)


@query("gower_encoded")
def q_gower_encoded(spark, sf_dir):
    """The notebook's variant: Gower on the encoded (one-hot + scaled) vector."""
    return G.gower_encoded(encoded(spark, sf_dir), "client_id", "features", N_LANDMARKS, SEED)


def gower_segmented(spark, sf_dir) -> DataFrame:
    vec = G.gower_vectors(subscribers(spark, sf_dir), "client_id", NUMERIC, CATEGORICAL, N_LANDMARKS, SEED)
    pca, _ = SG.pca_project(vec, "gower_vec", 2, "gpca")
    labelled, _ = SG.kmeans(persist(pca), "gpca", GOWER_K, SEED, "cluster")
    return labelled


@query("gower_embed_cluster")
def q_gower_embed_cluster(spark, sf_dir):
    return gower_segmented(spark, sf_dir).select("client_id", "pc1", "pc2", "cluster")


@query("bisecting_segments")
def q_bisecting_segments(spark, sf_dir):
    emb = embedded(spark, sf_dir)
    out, _ = SG.bisecting(emb, "pca", KMEANS_K, SEED, "cluster")
    return out.select("client_id", "cluster")


@query("dbscan_2d")
def q_dbscan_2d(spark, sf_dir):
    emb = embedded(spark, sf_dir)
    return D.dbscan(emb, "client_id", "x", "y", DBSCAN_EPS, DBSCAN_MIN)


# The notebooks' first density run takes eps 1.5 and 4 points on rows of some
# 2,900 distances, which is 0.16 on rows of 32; the test tables' evenly spread
# clients are sparser and need a little more to have dense places at all
GOWER_DBSCAN_EPS = 0.2
GOWER_DBSCAN_MIN = 4


def _gower_dbscan_sql() -> str:
    return f"""
    WITH RECURSIVE d AS MATERIALIZED ({_gower_sql()}),
    x AS MATERIALIZED (SELECT id_a AS id, list(d ORDER BY md5(CAST(landmark AS VARCHAR) || '{SEED}'), landmark) AS v FROM d GROUP BY id_a),
    near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a, x b WHERE list_distance(a.v, b.v) <= {GOWER_DBSCAN_EPS}),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {GOWER_DBSCAN_MIN}),
    link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    label(id, l) USING KEY (id) AS (SELECT id, id FROM core
      UNION SELECT link.b, min(w.l) FROM label w JOIN link ON link.a = w.id JOIN recurring.label r ON r.id = link.b WHERE w.l < r.l GROUP BY link.b)
    SELECT x.id AS client_id, CAST(coalesce(max(own.l), min(rim.l), -1) AS BIGINT) AS cluster, count(own.l) > 0 AS is_core
    FROM x LEFT JOIN label own ON own.id = x.id
           LEFT JOIN near ON near.a = x.id LEFT JOIN label rim ON rim.id = near.b GROUP BY x.id"""


def gower_rows(spark, sf_dir) -> DataFrame:
    """Subscribers with their distances to the landmark rows as an array. The
    joins behind a subscriber are made once, not for each of the three passes."""
    return G.gower_to_landmarks(persist(subscribers(spark, sf_dir)), "client_id", NUMERIC, CATEGORICAL, N_LANDMARKS, SEED, long=False)


@query("dbscan_gower", _gower_dbscan_sql())
def q_dbscan_gower(spark, sf_dir):
    """Density clusters of the distance rows (here distances to the landmark rows)."""
    return MDB.dbscan(persist(gower_rows(spark, sf_dir)), "client_id", "gower", GOWER_DBSCAN_EPS, GOWER_DBSCAN_MIN)


BALANCE_EDGES = (2000.0, 6000.0)


@query("cluster_compare",
       f"SELECT CASE WHEN amount < 170000.0 THEN 0 WHEN amount < 340000.0 THEN 1 ELSE 2 END AS cluster, "
       f"CASE WHEN balance < {BALANCE_EDGES[0]} THEN 0 WHEN balance < {BALANCE_EDGES[1]} THEN 1 ELSE 2 END "
       f"AS balance_band, COUNT(*) AS n FROM clients GROUP BY 1, 2")
def q_cluster_compare(spark, sf_dir):
    from callsheet.plans.explore_queries import banded
    b = banded(spark, sf_dir).withColumn(
        "balance_band", F.when(F.col("balance") < BALANCE_EDGES[0], 0)
        .when(F.col("balance") < BALANCE_EDGES[1], 1).otherwise(2))
    return SG.cluster_compare(b, "cluster", "balance_band")


@query("cluster_compare_models")
def q_cluster_compare_models(spark, sf_dir):
    emb = embedded(spark, sf_dir)
    km, _ = SG.kmeans(emb, "pca", KMEANS_K, SEED, "kmeans")
    bk, _ = SG.bisecting(km, "pca", KMEANS_K, SEED, "bisecting")
    return SG.cluster_compare(bk, "kmeans", "bisecting")
