"""Vector search and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank): each query's k nearest rows by cosine, the query itself aside; exact.

    The queries go to the executors in blocks of at most ``block`` vectors, so what is broadcast has a fixed bound; each
    batch of rows is one matrix product, and a task passes on k rows for each query of what it saw. Null vectors and
    those without length match nothing. Ties go to the lower id.
    """
    spark = rows.sparkSession
    ids = queries.filter(F.col(vector).isNotNull()).select(id_column).distinct().orderBy(id_column)
    out = None
    last = None
    while True:
        part = (ids if last is None else ids.filter(F.col(id_column) > last)).limit(block)
        got = queries.join(F.broadcast(part), id_column).dropDuplicates([id_column]).select(id_column, vector).collect()
        if not got:
            break
        got.sort(key=lambda r: r[0])
        last = got[-1][0]
        q = np.array([r[1] for r in got], dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
        send = spark.sparkContext.broadcast((np.array([r[0] for r in got]), q))

        def nearest(batches: Iterator[pd.DataFrame], send=send) -> Iterator[pd.DataFrame]:
            names, matrix = send.value
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                b = b[b[vector].notna()]
                if not len(b):
                    continue
                m = np.stack(b[vector].to_numpy()).astype(np.float64)
                size = np.linalg.norm(m, axis=1)
                s = np.where(size > 0, (matrix @ m.T) / np.where(size > 0, size, 1), -np.inf)
                own = b[id_column].to_numpy()
                s = np.where(names[:, None] == own[None, :], -np.inf, s)
                if best:
                    own = np.concatenate([best[0][0], np.broadcast_to(own, s.shape)], axis=1)
                    s = np.concatenate([best[0][1], s], axis=1)
                else:
                    own = np.broadcast_to(own, s.shape)
                order = np.lexsort((own, -s), axis=1)[:, :k]
                best = [(np.take_along_axis(own, order, 1), np.take_along_axis(s, order, 1))]
            if best:
                own, s = best[0]
                f = pd.DataFrame({"query_id": np.repeat(names, own.shape[1]), "id": own.ravel(), "score": s.ravel()})
                yield f[np.isfinite(f["score"])]

        found = rows.select(id_column, vector).mapInPandas(nearest, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
        if len(got) < block:
            break
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, ap, recall, precision, mrr) at k, of ranked (query_id, id, rank) against relevant (query_id, id).

    Queries without a hit score 0; queries without relevant rows are left out.
    """
    hits = ranked.join(relevant.withColumn("rel", F.lit(1.0)), ["query_id", "id"], "left").na.fill(0.0, ["rel"])
    return graded_metrics(hits, relevant.groupBy("query_id").agg(F.count("*").alias("m")), k)


def graded_metrics(hits: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, ap, recall, precision, mrr) at k, of hits (query_id, id, rank, rel: 1.0 or 0.0), where ``totals``
    (query_id, m) says how many relevant rows a query has in all."""
    hits = hits.filter(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hits.withColumn("seen", F.sum("rel").over(w))
    got = run.groupBy("query_id").agg(
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("rel") * F.col("seen") / F.col("rank")).alias("aps"), F.sum("rel").alias("n"), F.max(F.col("rel") / F.col("rank")).alias("mrr")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return totals.join(got, "query_id", "left").select(
        "query_id", (z("dcg") / ideal).alias("ndcg"), (z("aps") / F.least(F.col("m"), F.lit(k))).alias("ap"), (z("n") / F.col("m")).alias("recall"), (z("n") / k).alias("precision"), z("mrr").alias("mrr")
    )
