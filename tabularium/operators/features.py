"""Vector features: cosine search, TF-IDF with k-means, isolation scores, density clusters, PCA."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def nearest_labels(rows: DataFrame, key: str, vector: str, known: DataFrame, label: str, known_vector: str, least: float = 0.85, most_known: int = 10_000) -> DataFrame:
    """key, label of the most similar known vector (ties: the lesser label), 'unknown' below ``least``.

    The known vectors are a labelled set of bounded size (checked), which every task compares with its own rows as one matrix.
    """
    table = known.select(label, known_vector).orderBy(label).limit(most_known + 1).toPandas()
    if len(table) > most_known:
        raise ValueError(f"more than {most_known} known vectors")
    names = table[label].to_numpy()
    matrix = np.array(table[known_vector].tolist(), dtype=float).reshape(len(table), -1) if len(table) else np.zeros((0, 1))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.array(batch[vector].tolist(), dtype=float).reshape(len(batch), -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            s = v @ matrix.T if len(names) and len(v) else np.zeros((len(batch), 1))
            best = s.argmax(1)
            score = s[np.arange(len(batch)), best]
            yield pd.DataFrame({key: batch[key], "label": [str(names[i]) if x >= least and len(names) else "unknown" for i, x in zip(best, score, strict=True)], "score": score})

    return rows.select(key, vector).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, label string, score double")


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label."""
    parts = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("centroid"))


def text_clusters(docs: DataFrame, key: str, text: str, k: int = 5, features: int = 1024, seed: int = 42, nearest: int = 3) -> DataFrame:
    """key, cluster, rank: TF-IDF over hashed words and k-means; the ``nearest`` rows to each centre, of which Spark keeps as many in each task before the shuffle."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_all", pattern=r"[^\p{L}]+"), StopWordsRemover(inputCol="_all", outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_x"), KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed, maxIter=10),
    ]
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias(text))
    model = Pipeline(stages=stages).fit(rows)
    spark = docs.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-1].clusterCenters())], "cluster int, centre array<double>")
    found = model.transform(rows).select(key, "cluster", vector_to_array("_x").alias("_v")).join(centres, "cluster")
    gap = F.aggregate(F.zip_with("_v", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return found.withColumn("_d", gap).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("_d", key))).where(F.col("rank") <= nearest).select(key, "cluster", "rank")


def isolation_scores(rows: DataFrame, key: str, columns: list[str], trees: int = 64, sample: int = 256, seed: int = 7) -> DataFrame:
    """key, score (0 to 1, higher: easier to isolate).  Trees are grown on bounded samples; every row is scored."""
    pool = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().orderBy(F.xxhash64(*columns), *columns).limit(trees * sample).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, min(sample, len(pool))))))

    def c(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) else []
        if depth >= limit or len(x) <= 1 or not len(spread):
            return depth + c(len(x))
        f = int(rng.choice(spread))
        at = rng.uniform(x[:, f].min(), x[:, f].max())
        return f, at, grow(x[x[:, f] < at], depth + 1), grow(x[x[:, f] >= at], depth + 1)

    forest = [grow(pool[rng.choice(len(pool), min(sample, len(pool)), replace=False)], 0) for _ in range(trees)] if len(pool) else []
    norm = c(min(sample, len(pool))) or 1.0

    def walk(node, x: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[at] += node
        elif len(at):
            f, cut, left, right = node
            low = x[at, f] < cut
            walk(left, x, out, at[low])
            walk(right, x, out, at[~low])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            x = np.where(np.isnan(x), 0.0, x)
            total = np.zeros(len(x))
            for tree in forest:
                walk(tree, x, total, np.arange(len(x)))
            yield pd.DataFrame({key: batch[key], "score": np.round(2 ** (-total / max(1, len(forest)) / norm), 6)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *[F.col(x).cast("double").alias(x) for x in columns]).mapInPandas(run, f"{key} {kind}, score double")


def density_noise(rows: DataFrame, key: str, columns: list[str], radius: float, least: int = 2) -> DataFrame:
    """key, core, noise: core rows have ``least`` rows (themselves included) within ``radius``; noise is what no core row is that near to.

    Rows are counted per distinct point first.  Points lie in cells whose diagonal is the
    radius: all of a cell with ``least`` rows are core, and none of them is compared with
    its like.  Only points of thinner cells meet those of the cells around, so a point of a
    dense cell meets ``least`` - 1 of each cell at most.
    """
    side, reach = radius / len(columns) ** 0.5, int(np.ceil(len(columns) ** 0.5))
    points = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.array(*[F.floor(F.col(c) / side) for c in columns]))
    dense = points.groupBy("_cell").agg((F.sum("_n") >= least).alias("_dense"))
    points = points.join(dense, "_cell")
    around = F.array(*[F.array(*[F.get("_cell", F.lit(i)) + F.lit(d) for i, d in enumerate(step)]) for step in product(range(-reach, reach + 1), repeat=len(columns))])
    thin = points.where("not _dense").select(*columns, F.explode(around).alias("_cell"))
    other = points.select(*[F.col(c).alias(f"_{c}") for c in columns], F.col("_n").alias("_m"), "_cell", "_dense")
    gap = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in columns), F.lit(0.0))
    near = thin.join(other, "_cell").where(gap <= radius * radius)
    size = near.groupBy(*columns).agg(F.sum("_m").alias("_near"))
    cores = size.where(F.col("_near") >= least).select(*[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_core"))
    beside = near.join(cores, [f"_{c}" for c in columns], "left").groupBy(*columns).agg(F.max(F.coalesce("_core", F.lit(False)) | F.col("_dense")).alias("_beside"), F.sum("_m").alias("_near"))
    told = points.select(*columns, "_dense").join(beside, columns, "left")
    core = F.col("_dense") | F.coalesce(F.col("_near") >= least, F.lit(False))
    told = told.select(*columns, core.alias("core"), (~core & ~F.coalesce("_beside", F.lit(False))).alias("noise"))
    return rows.join(told, columns).select(key, "core", "noise")


def projected(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """key and the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(data).transform(data).select(key, vector_to_array("_p").alias("components"))
