"""Append-only caches: latest versions, reuse, multi-key lookups, audits and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; a reduction with map-side partials, so a hot key needs no sort."""
    rest = [c for c in df.columns if c not in key]
    names = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(*key).agg(F.max(F.struct(*names)).alias("_x")).select(*key, *[F.col(f"_x.{c}") for c in rest])


def split_cached(wanted: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cached, remaining): the rows whose key the cache has, and the others; null keys remain."""
    return wanted.join(cache, key, "left_semi"), wanted.join(cache, key, "left_anti")


def first_match(df: DataFrame, row: str, keys: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """(row, value): the value of the first of a row's candidate keys (an array, in order of preference) that is known;
    null where none is. Null keys never match."""
    each = df.select(row, F.posexplode_outer(keys).alias("_p", key))
    hit = each.join(known, key, "left")
    return hit.groupBy(row).agg(F.min(F.when(F.col(value).isNotNull(), F.struct("_p", value))).alias("_x")).select(row, F.col(f"_x.{value}").alias(value))


def audit(predictions: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """(*key, n_predictions, n_reviews) where both differ; counted before the join, so it moves one row a key."""
    p = predictions.groupBy(*key).agg(F.count("*").alias("n_predictions"))
    r = reviews.groupBy(*key).agg(F.count("*").alias("n_reviews"))
    both = p.join(r, key, "full_outer").na.fill(0, ["n_predictions", "n_reviews"])
    return both.filter("n_predictions <> n_reviews")


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, row: str) -> DataFrame:
    """(row, value): for each left row the value of the last right row of the same key that is no later; of equal times
    the highest value. Both sides are sorted together once per key, so no pairs are formed; null keys match nothing."""
    latest_right = right.filter(" and ".join(f"{k} is not null" for k in key)).groupBy(*key, at).agg(F.max(value).alias(value))
    a = left.select(*key, at, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value), row)
    b = latest_right.select(*key, at, F.lit(0).alias("_side"), value, F.lit(None).cast(dict(left.dtypes)[row]).alias(row))
    w = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("_v", F.last(value, True).over(w)).filter("_side = 1").select(row, F.col("_v").alias(value))
