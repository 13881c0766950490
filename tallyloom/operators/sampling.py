"""Limits, repeats, shuffles and quota samplers; every choice follows a seeded hash, so that it can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order by which rows can be sorted or ranked; the same on every run."""
    return F.xxhash64(*keys, F.lit(seed))


def limited(df: DataFrame, order: list[str], limit: int | float | None) -> DataFrame:
    """The first rows by ``order``: a number, a share of all rows (rounded down), or all for None and 0."""
    if not limit:
        return df
    if limit < 0:
        raise ValueError("a limit isn't negative")
    return df.orderBy(*order).limit(int(df.count() * limit) if isinstance(limit, float) else limit)


def repeated(df: DataFrame, k: int, order: str) -> DataFrame:
    """Each row k times: ``repeat`` 0..k-1 beside it, ``group`` its row number and ``id`` group * k + repeat, by ``order``."""
    numbered = _numbered(df, order)
    return numbered.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("id", F.col("group") * k + F.col("repeat"))


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """``group``: 0-based row number by ``order``, over ranges instead of one task."""
    from tallyloom.operators.prefix import running_sum

    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [], [order], "_one", "group").withColumn("group", F.col("group") - 1).drop("_one")


def first_per_group(df: DataFrame, group: str, order: list[str], n: int, default: str = "default") -> DataFrame:
    """The first n rows of each group, renumbered from 0; null groups are called ``default``."""
    g = df.withColumn(group, F.coalesce(group, F.lit(default)))
    # the filter is on the plain row number, so that each task keeps n rows of a group before the shuffle
    ranked = g.withColumn("id", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("id") <= n)
    return ranked.withColumn("id", F.col("id") - 1)


def quotas(sizes: DataFrame, count: int, how: str) -> DataFrame:
    """(dataset, n, quota) from (dataset, n, weight): how many rows of each data set make ``count`` together.

    ``weighted``: by weight, rounded down, the last data set takes the rest; ``uniform``: count by number of data sets;
    ``stratified``: by size, one at least, the last takes the rest. No quota is above the data set's size.
    """
    all_sets = Window.partitionBy(F.lit(0))  # over one row for each data set
    last = F.row_number().over(all_sets.orderBy(F.col("dataset").desc())) == 1
    share = {"weighted": F.col("weight") / F.sum("weight").over(all_sets), "uniform": 1 / F.count("*").over(all_sets), "stratified": F.col("n") / F.sum("n").over(all_sets)}[how]
    base = F.floor(share * count).cast("bigint")
    if how == "uniform":
        return sizes.withColumn("quota", F.least("n", base)).select("dataset", "n", "quota")
    part = sizes.withColumns({"_base": base, "_last": last})
    rest = F.lit(count) - F.sum(F.when(F.col("_last"), 0).otherwise(F.col("_base"))).over(all_sets)
    return part.withColumn("quota", F.least("n", F.when(F.col("_last"), rest).otherwise(F.col("_base")))).select("dataset", "n", "quota")


def sampled(df: DataFrame, wanted: DataFrame, dataset: str, key: str, seed: int = 42) -> DataFrame:
    """``quota`` rows of each data set without replacement, in the order of seeded hashes."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(dataset).orderBy(shuffled_order(seed, key), key)))
    q = wanted.select(F.col("dataset").alias("_d"), "quota")
    return ranked.join(q, F.col(dataset) == F.col("_d")).filter(F.col("_r") <= F.col("quota")).drop("_r", "_d", "quota")


def picks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Near, middle and far rows of each group: ranks 0, n/2 and n-1, each row once, as (``pick``)."""
    from tallyloom.operators.prefix import running_sum

    # ranks by ranges, so that a group that holds most rows isn't one task
    r = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [group], order, "_one", "_r").drop("_one")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    r = r.join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_r", F.col("_r") - 1)
    pick = F.when(F.col("_r") == 0, "near").when(F.col("_r") == F.floor(F.col("_n") / 2), "middle").when(F.col("_r") == F.col("_n") - 1, "far")
    return r.withColumn("pick", pick).filter("pick is not null").drop("_r", "_n", "_g")


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in an order, with ``place`` counted from 1; ranks by ranges, not one task."""
    from tallyloom.operators.prefix import running_sum

    if number < 1 or size < 1:
        raise ValueError("pages and their sizes count from 1")
    ranked = running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", "place").drop("_one")
    return ranked.filter(F.col("place").between((number - 1) * size + 1, number * size))


def flat_weights(tree: dict, path: str = "", share: float = 1.0) -> list[tuple[str, str, float]]:
    """(path, dataset, weight) of a nested collection, whose nodes have a ``weight`` and a ``dataset`` or ``parts``: weights
    are shares among siblings, multiplied down to the leaves. For configurations, so on the driver."""
    if "dataset" in tree:
        return [(path, tree["dataset"], share)]
    parts = tree.get("parts", [])
    total = sum(p["weight"] for p in parts)
    if parts and total <= 0:
        raise ValueError("weights must sum to more than 0")
    return [leaf for p in parts for leaf in flat_weights(p, "/".join(x for x in (path, p.get("name", "")) if x), share * p["weight"] / total)]


def of_runs(df: DataFrame, runs: list[str], column: str = "run_dir") -> DataFrame:
    """The rows of the named runs, whose folder is the name or ends in it."""
    c = F.col(column)
    keep = c.isin(runs)
    for r in runs:
        keep = keep | c.endswith(f"/{r}")
    return df.filter(keep)
