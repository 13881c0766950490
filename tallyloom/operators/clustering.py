"""Clusters of reference ideas, and how flexible and original new ideas are against them."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scoring


def reference_clusters(pool: DataFrame, vector: str = "embedding", seed: int = 42) -> tuple[KMeansModel, int]:
    """K-means over a pool of embeddings; k grows with the pool as the least of sqrt(n/2), n/10 and n/20, two at least."""
    n = pool.filter(F.col(vector).isNotNull()).count()
    k = max(2, min(int(math.sqrt(n / 2)), n // 10, n // 20))
    model = KMeans(k=k, seed=seed, featuresCol="_f").fit(pool.filter(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_f")))
    return model, k


def distances(ideas: DataFrame, model: KMeansModel, vector: str = "embedding") -> DataFrame:
    """``ideas`` with ``cluster`` and ``distance`` to its centre; null vectors are dropped."""
    centers = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    found = model.transform(ideas.filter(F.col(vector).isNotNull()).withColumn("_f", array_to_vector(F.col(vector).cast("array<double>"))))
    return found.withColumn("distance", scoring.euclidean(vector_to_array("_f"), F.get(centers, F.col("prediction")))).withColumnRenamed("prediction", "cluster").drop("_f")


def idea_scores(ideas: DataFrame, pool: DataFrame, sample: str, vector: str = "embedding", outlier: float = 1.5) -> DataFrame:
    """(sample, n, flexibility, originality).

    flexibility: clusters reached, plus three for each outlier, by the root of the number of ideas. originality: the sum
    of distance by mean distance within the cluster, less ``outlier``, over the ideas beyond it. The pool's mean
    distances are one row for each cluster.
    """
    model, _ = reference_clusters(pool, vector)
    inside = distances(pool, model, vector).groupBy("cluster").agg(F.avg("distance").alias("_mean"))
    d = distances(ideas, model, vector).join(F.broadcast(inside), "cluster", "left")
    ratio: Column = F.coalesce(F.try_divide("distance", "_mean"), F.lit(0.0))
    far = ratio > outlier
    g = d.groupBy(sample).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(~far, F.col("cluster"))).alias("_c"), F.count_if(far).alias("_o"), F.coalesce(F.sum(F.when(far, ratio - outlier)), F.lit(0.0)).alias("originality")
    )
    return g.select(sample, "n", ((F.col("_c") + 3 * F.col("_o")) / F.sqrt("n")).alias("flexibility"), "originality")
