"""Queries over vectors and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.operators import features
from tabularium.session import ship_package

from .results import read


def cosine_classify(spark, sf_dir):
    """Vectors with the label whose mean vector is most similar; unknown below .2."""
    ship_package(spark)
    (rows,) = read(spark, sf_dir, "embeddings")
    known = features.centroids(rows, "label", "embedding").select(F.col("label").cast("string").alias("name"), "centroid")
    return features.nearest_labels(rows, "vec_id", "embedding", known, "name", "centroid", least=0.2).select("vec_id", "label", F.round("score", 4).alias("score"))


SQL_COSINE = """
WITH p AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, c.label::VARCHAR AS label, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
SELECT vec_id, CASE WHEN s >= 0.2 THEN label ELSE 'unknown' END AS label, round(s, 4) AS score FROM b"""


def vector_norms(spark, sf_dir):
    """Similarity of each vector to the mean of its label."""
    (rows,) = read(spark, sf_dir, "embeddings")
    means = features.centroids(rows, "label", "embedding")
    return rows.join(means, "label").select("vec_id", F.round(features.cosine(F.col("embedding"), F.col("centroid")), 4).alias("similarity"))


SQL_NORMS = """
WITH p AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS similarity FROM embeddings JOIN c USING (label)"""


def kmeans_tfidf(spark, sf_dir):
    """Documents in five clusters by TF-IDF, ranked by distance from the centre."""
    (documents,) = read(spark, sf_dir, "documents")
    return features.text_clusters(documents, "doc_id", "text")


def isolation(spark, sf_dir):
    (events,) = read(spark, sf_dir, "events")
    return features.isolation_scores(events.withColumn("hour", F.hour("ts")), "event_id", ["value", "user_id", "hour"])


def dbscan(spark, sf_dir):
    """Customers with no dense neighbourhood in (balance, nation)."""
    (customer,) = read(spark, sf_dir, "customer")
    return features.density_noise(customer.select("c_custkey", (F.col("c_acctbal") / 10).alias("x"), (F.col("c_nationkey") * 2.0).alias("y")), "c_custkey", ["x", "y"], 3.0, 3)


SQL_DBSCAN = """
WITH p AS (SELECT c_custkey, c_acctbal / 10 AS x, c_nationkey * 2.0::DOUBLE AS y FROM customer),
near AS (SELECT a.c_custkey AS k, b.c_custkey AS o FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9.0),
size AS (SELECT k, count(*) AS n FROM near GROUP BY k)
SELECT s.k AS c_custkey, s.n >= 3 AS core, NOT bool_or(t.n >= 3) AS noise FROM size s JOIN near USING (k) JOIN size t ON t.k = near.o GROUP BY ALL"""


def components(spark, sf_dir):
    """The first two principal components."""
    (rows,) = read(spark, sf_dir, "embeddings")
    return features.projected(rows, "vec_id", "embedding").select("vec_id", F.transform("components", lambda x: F.round(F.abs(x), 4)).alias("components"))


QUERIES = {
    "cosine_classify": (cosine_classify, SQL_COSINE),
    "vector_norms": (vector_norms, SQL_NORMS),
    "kmeans_tfidf": (kmeans_tfidf, None),
    "isolation": (isolation, None),
    "dbscan": (dbscan, SQL_DBSCAN),
    "components": (components, None),
}
