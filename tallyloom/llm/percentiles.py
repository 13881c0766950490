"""Percentiles of very large numeric columns, mergeable across partitions and days.

Method: SQL cumulative frequencies. Values reduce to counts by group and value, the counts are range-sorted, window
sums run inside each range and get the offsets of the ranges before, and the first values that reach the target
ranks are the percentiles. The counts by group, day and value are the mergeable form: states add up.

Values are first rounded to ``digits`` significant digits, so a state's size is bounded by the values' magnitudes
(900 bins a decade at three digits) and not by the rows. Ranks are exact; a percentile differs from the exact one by
at most the rounding, half a unit of the last digit (0.5 % at three digits), and integers of up to that many digits
are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.prefix import running_sum

PERCENTS = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0)


def max_relative_error(digits: int) -> float:
    return 0.5 * 10.0 ** (1 - digits)


def rounded(value: Column, digits: int) -> Column:
    """``value`` to significant digits; zero and infinities stay, null and NaN become null."""
    x = value.cast("double")
    size = F.abs(x)
    e = F.floor(F.log10(size)).cast("int") - (digits - 1)
    up = F.pow(F.lit(10.0), e.cast("double"))
    down = F.pow(F.lit(10.0), (-e).cast("double"))
    r = F.when(e < 0, F.round(size * down) / down).otherwise(F.round(size / up) * up)
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x), None).when((size == inf) | (x == 0), F.when(x == 0, 0.0).otherwise(x)).otherwise(F.signum(x) * r)


def value_counts(df: DataFrame, groups: dict[str, Column], metrics: dict[str, Column], digits: int = 3) -> DataFrame:
    """The mergeable state: (*groups, metric, value, n). Null and NaN values count nowhere; null groups are groups."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), rounded(c, digits).alias("value")) for m, c in metrics.items()]))
    flat = df.select(*[c.alias(g) for g, c in groups.items()], each.alias("_v")).select(*groups, "_v.metric", "_v.value").filter("value is not null")
    return flat.groupBy(*groups, "metric", "value").agg(F.count("*").alias("n"))


def merge(states: DataFrame, groups: list[str]) -> DataFrame:
    """States of any parts, days or machines as one, by the groups that remain."""
    return states.groupBy(*groups, "metric", "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], percents: tuple[float, ...] = PERCENTS, digits: int = 3) -> DataFrame:
    """(*groups, metric, p, value, n, max_rel_error): the value at rank ceil(p/100 * n), at least 1, of each group.

    ``n`` is the group's number of values. An empty state gives no rows; repeated rows count as often as they occur.
    """
    by = [*groups, "metric"]
    sums = running_sum(state, by, ["value"], "n")
    total = state.groupBy(*by).agg(F.sum("n").alias("_n"))
    left, right = sums.alias("l"), total.alias("r")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    target = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("_n") / 100.0)).cast("bigint")
    return (
        left.join(right, same, "left")  # each row has its total; a left join never broadcasts the counts
        .select(*[F.col(f"l.{c}") for c in by], "l.value", "l.n", "running", "_n")
        .withColumn("p", F.explode(F.array(*map(F.lit, percents))))
        .filter((F.col("running") - F.col("n") < target) & (target <= F.col("running")))
        .select(*by, "p", "value", F.col("_n").alias("n"), F.lit(max_relative_error(digits)).alias("max_rel_error"))
    )
