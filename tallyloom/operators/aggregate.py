"""Aggregations over tidy sample scores: one row for each sample and metric.

Every aggregation is a plain group-by with map-side partial sums; groups of samples collapse to one row (n, c) before
anything is joined or exploded, so a hot task or group costs no more than its share of the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring

#: Aggregations by name: DataFrame -> DataFrame.
AGGREGATIONS: dict[str, Callable[..., DataFrame]] = {}


def register_aggregation(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in AGGREGATIONS:
            raise ValueError(f"aggregation {name} exists")
        AGGREGATIONS[name] = f
        return f

    return add


def tidy(reviews: DataFrame) -> DataFrame:
    """(review_id, rec_id, task, model, sample_index, group_id, prediction, metric, value) of the reviews with a value."""
    s = F.col("sample_score.score")
    return reviews.select(
        "review_id", "rec_id", "task", F.lower(F.trim("model")).alias("model"), "sample_index", F.col("sample_score.group_id").alias("group_id"), s.getField("extracted_prediction").alias("prediction"),
        F.explode(s.getField("value")).alias("metric", "value"),
    )


@register_aggregation("mean")
def mean(scores: DataFrame, by: list[str]) -> DataFrame:
    """(*by, metric, score, num); rows that lack a metric don't count for it."""
    return scores.groupBy(*by, "metric").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("score"), F.count("value").alias("num"))


@register_aggregation("clipped_mean")
def clipped_mean(scores: DataFrame, by: list[str]) -> DataFrame:
    """mean(), clamped to 0..1 after averaging."""
    return mean(scores, by).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))


def _grouped(scores: DataFrame, by: list[str], group: str) -> DataFrame:
    """(*by, metric, group, n, c, total, k): k is samples by groups, rounded down."""
    per = scores.groupBy(*by, "metric", group).agg(F.count("*").alias("n"), F.sum("value").cast("bigint").alias("c"))
    w = Window.partitionBy(*by, "metric")  # over one row a group
    return per.withColumns({"total": F.sum("n").over(w), "groups": F.count("*").over(w)}).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("total") / F.col("groups"))).cast("bigint"))


@register_aggregation("mean_and_pass_at_k")
def mean_and_pass_at_k(scores: DataFrame, by: list[str], group: str = "group_id") -> DataFrame:
    """mean() and metric_pass@1..k; each group counts as often as it has samples. Values are 0 or 1."""
    g = _grouped(scores, by, group).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))))
    p = g.withColumn("p", scoring.pass_at_k(F.col("n"), F.col("c"), F.col("j")))
    added = p.groupBy(*by, F.concat("metric", F.lit("_pass@"), "j").alias("metric")).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("num"))
    return mean(scores, by).unionByName(added)


@register_aggregation("mean_and_pass_hat_k")
def mean_and_pass_hat_k(scores: DataFrame, by: list[str], group: str = "group_id") -> DataFrame:
    """mean() and metric_pass^k for one k: samples by groups, but no more than the smallest group has, and 1 at least."""
    g = _grouped(scores, by, group)
    w = Window.partitionBy(*by, "metric")
    g = g.withColumn("k", F.greatest(F.lit(1), F.least("k", F.min("n").over(w))))
    p = g.withColumn("p", scoring.pass_hat_k(F.col("n"), F.col("c"), F.col("k")))
    added = p.groupBy(*by, F.concat("metric", F.lit("_pass^"), "k").alias("metric")).agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("num"))
    return mean(scores, by).unionByName(added)


@register_aggregation("mean_and_vote_at_k")
def mean_and_vote_at_k(scores: DataFrame, by: list[str], group: str = "group_id", order: str = "review_id") -> DataFrame:
    """mean() and metric_vote@1..k: of a group's first n answers the most frequent (of equals the first seen) is right
    if any sample with it has value 1. Counts by answer and n are built from one row for each group, answer and rank."""
    g = [*by, "metric", group]
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy(*g).orderBy(order)))
    sizes = _grouped(scores, by, group).select(*g, "k")
    same = [ranked[c].eqNullSafe(sizes[c]) for c in g]
    first = ranked.join(sizes, same, "left").select(*[ranked[c] for c in g], "prediction", "value", "r", "k").filter("r <= k")
    each = first.withColumn("j", F.explode(F.sequence(F.col("r").cast("bigint"), F.col("k"))))
    votes = each.groupBy(*g, "j", "prediction").agg(F.count("*").alias("n"), F.min("r").alias("at"), F.max((F.col("value") == 1.0).cast("double")).alias("right"))
    best = votes.groupBy(*g, "j").agg(F.max_by("right", F.struct("n", -F.col("at"))).alias("v"), F.lit(1).alias("_one"))
    weights = scores.groupBy(*g).agg(F.count("*").alias("m"))
    joined = best.join(weights, [best[c].eqNullSafe(weights[c]) for c in g]).select(*[best[c] for c in g], "j", "v", "m")
    added = joined.groupBy(*by, F.concat("metric", F.lit("_vote@"), "j").alias("metric")).agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("score"), F.sum("m").alias("num"))
    return mean(scores, by).unionByName(added)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def round4(c: Column) -> Column:
    """To 4 digits, after 9, so that averages half way between two values round alike whatever the order of summing."""
    return F.round(F.round(c, 9), 4)


def confusion(df: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """(*by, tp, fp, fn, tn, precision, recall, f1, accuracy, yes_ratio, mcc) of two boolean columns; 0 for empty ratios."""
    counts = df.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *by, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp + fp, tp + fp + fn + tn).alias("yes_ratio"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def class_scores(df: DataFrame, by: list[str], predicted: str, actual: str) -> DataFrame:
    """(*by, accuracy, macro_f1, weighted_f1, micro_f1, n) over classes, from counts by pair; null predictions are no rows."""
    pairs = df.filter(F.col(predicted).isNotNull() & F.col(actual).isNotNull()).groupBy(*by, F.col(predicted).alias("p"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("p").alias("label"), F.col("n").alias("as_p"), F.lit(0).cast("bigint").alias("as_a")), F.struct(F.col("a").alias("label"), F.lit(0).cast("bigint").alias("as_p"), F.col("n").alias("as_a"))))
    flat = pairs.select(*by, (F.col("p") == F.col("a")).alias("same"), sides.alias("s")).select(*by, "same", "s.*")
    per = flat.groupBy(*by, "label").agg(F.sum(F.when(F.col("same"), F.col("as_a")).otherwise(0)).alias("tp"), F.sum("as_p").alias("n_p"), F.sum("as_a").alias("n_a"))
    f1 = ratio(2 * F.col("tp").cast("double"), F.col("n_p") + F.col("n_a"))
    return per.withColumn("f1", f1).groupBy(*by).agg(
        ratio(F.sum("tp").cast("double"), F.sum("n_a")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("n_a")), F.sum("n_a")).alias("weighted_f1"),
        ratio(2 * F.sum("tp").cast("double"), F.sum("n_p") + F.sum("n_a")).alias("micro_f1"), F.sum("n_a").alias("n"),
    )


def all_right(df: DataFrame, by: list[str], key: list[str], correct: Column) -> DataFrame:
    """(*by, score, num): the share of keys all of whose rows are right."""
    per = df.groupBy(*by, *key).agg(F.bool_and(correct).alias("ok"))
    return per.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("score"), F.count("*").alias("num"))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[int, ...]) -> DataFrame:
    """(*by, p, value): the sorted value at index int(n*p/100), as load tests report it; no index, no row.

    Values reduce to counts before they are ordered, and the order runs over ranges (see prefix.py), so no group is
    sorted in one task.
    """
    from tallyloom.operators.prefix import running_sum

    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    sums = running_sum(counts, by, ["value"], "n")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = sums.alias("l").join(totals.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], "left").select(*[F.col(f"l.{c}") for c in by], "l.value", "l.n", "running", "total")
    at = F.floor(F.col("total") * F.col("p") / 100)
    return joined.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).filter((F.col("running") - F.col("n") <= at) & (at < F.col("running"))).select(*by, "p", "value")


def tree_levels(df: DataFrame, levels: list[str], score: str = "score", weight: str = "weight") -> DataFrame:
    """(level, key, micro, macro, weighted, n): averages at every level of a hierarchy by one pass of grouping sets.

    macro is the mean of the child level's micro averages, at the lowest level the micro average. Weights that add up
    to 0 give the plain mean. Null keys are dropped.
    """
    leaf = df.dropna(subset=levels).groupBy(*levels).agg(F.sum(score).alias("s"), F.count(score).alias("n"), F.sum(F.col(score) * F.col(weight)).alias("sw"), F.sum(weight).alias("w"))
    out = None
    child = None
    for i in range(len(levels), 0, -1):
        keys = levels[:i]
        at = leaf.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum("w").alias("w"))
        at = at.withColumn("micro", ratio(F.col("s"), F.col("n")))
        if child is not None:
            at = at.join(child.groupBy(*keys).agg(F.avg("micro").alias("macro")), keys)
        else:
            at = at.withColumn("macro", F.col("micro"))
        child = at.select(*keys, "micro")
        row = at.select(
            F.lit(levels[i - 1]).alias("level"), F.concat_ws("/", *keys).alias("key"), round4(F.col("micro")).alias("micro"), round4(F.col("macro")).alias("macro"),
            round4(F.when(F.col("w") == 0, F.col("micro")).otherwise(ratio(F.col("sw"), F.col("w")))).alias("weighted"), "n",
        )
        out = row if out is None else out.unionByName(row)
    return out


def top_share_mean(df: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """(*by, score, n): the mean of the highest ``share`` of values, one at least."""
    w = Window.partitionBy(*by)
    ranked = df.filter(F.col(value).isNotNull()).withColumns({"r": F.row_number().over(w.orderBy(F.col(value).desc())), "n": F.count("*").over(w)})
    keep = F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    return ranked.filter(F.col("r") <= keep).groupBy(*by).agg(F.avg(value).alias("score"), F.count("*").alias("n"))


def bootstrap_stderr(df: DataFrame, by: list[str], value: str, key: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(*by, stderr, n): the standard error of the mean by Poisson bootstrap.

    A row's weight in a round follows from hashes of its key, so a round needs no resampling and all rounds are sums in
    one pass, combined before the shuffle. Null values don't count; one row alone has no error and gives 0.
    """
    u = lambda b: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(b)), F.lit(1_000_003)) + 0.5) / 1_000_003
    steps, p, total = [], math.exp(-1.0), 0.0
    for i in range(9):  # the Poisson distribution of mean 1; nine and more are one in a million
        total += p
        steps.append((i, total))
        p /= i + 1
    def weight(b: int) -> Column:  # noqa: E306
        x = u(b)
        w = F.lit(9)
        for i, t in reversed(steps):
            w = F.when(x < t, i).otherwise(w)
        return w

    kept = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda b: weight(b)).alias("_w"))
    # positions of an array are keys of the second sum: rounds rows a group leave each task
    each = kept.select(*by, "_v", F.posexplode("_w").alias("_b", "_n")).groupBy(*by, "_b").agg(F.sum("_n").alias("_m"), F.sum(F.col("_n") * F.col("_v")).alias("_s"), F.count("*").alias("_rows"))
    return each.groupBy(*by).agg(F.coalesce(F.stddev(F.try_divide("_s", "_m")), F.lit(0.0)).alias("stderr"), F.max("_rows").alias("n"))
