"""Running sums over a total order, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str = "running", partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group up to and with this one.

    The rows are range-sorted by group and order, each range sums on its own, and a small table of one row for
    each range and group gives the offsets. A group that holds most rows spreads over as many ranges as its
    share asks for. ``order`` must tell the rows of a group apart, or ties fall in any order (their sums then
    differ, the set of sums doesn't). Null groups and orders sort first and are kept; null values count 0. The
    ranges are written once, as sampled bounds might differ if an executor's loss made Spark sort again.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    ranged = durable(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *groups).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    amount = F.coalesce(F.col(value), F.lit(0))
    offsets = (
        ranged.groupBy("_range", *groups)
        .agg(F.sum(amount).alias("_part"))
        .select("_range", *groups, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_offset"))
    )
    left, right = ranged.withColumn("_in", F.sum(amount).over(inside)).alias("l"), offsets.alias("r")
    same: Column = F.col("l._range") == F.col("r._range")
    for g in groups:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    # each row has its offset; a left join may broadcast the offsets where they are small, but never the rows
    return left.join(right, same, "left").select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._in") + F.col("r._offset")).alias(out))
