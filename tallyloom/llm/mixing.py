"""Mixing sources to target shares along a curriculum.

Method: each source has a weight schedule over training time. Its integral is the source's demand for tokens;
documents, put in a random order within their source, get the time at which the integrated schedule asks for their
place in the cumulated tokens (its inverse), and all are range-sorted by that time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.prefix import running_sum
from tallyloom.session import durable

Knots = list[tuple[float, float]]


@dataclass
class Mixture:
    """``rows``: position, source, doc_id, copy, n_tokens in the order of training. ``shares``: source, target_share,
    planned_share, reached_share, tokens, n_texts, most_copies, supply_tokens, max_repeats."""

    rows: DataFrame
    shares: DataFrame


def normalised_source(c: Column) -> Column:
    """A source's name in one spelling: lower case, no blanks around, _ for - and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def segments(knots: Knots) -> list[tuple[float, float, float, float, float]]:
    """A schedule of linear pieces as (t0, t1, w0, slope, c0): c0 is the integral before t0, all integrals scaled to 1.

    Knots are (time, weight) from 0 to 1 in order; weights are not negative and not all zero.
    """
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from 0 to 1 in order with weights of 0 or more")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if area <= 0:
        raise ValueError("a schedule needs a weight above 0")
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, w0 / area, (w1 - w0) / area / (t1 - t0), c))
        c += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_of(share: Column, schedule: Column) -> Column:
    """The time by which a source has given ``share`` of its tokens; ``schedule`` is an array of segments()."""
    piece = F.element_at(F.filter(schedule, lambda s: s["c0"] <= share), -1)
    need, w, slope = share - piece["c0"], piece["w0"], piece["slope"]
    # of w*x + slope/2*x^2 = need, in the form that also holds where the slope is 0
    root = F.sqrt(F.greatest(F.lit(0.0), w * w + slope * need * 2))
    return F.least(piece["t1"], piece["t0"] + F.coalesce(F.try_divide(need * 2, w + root), F.lit(0.0)))


def _short_to_long(mean: dict[str, float], share: dict[str, float], strength: float) -> dict[str, Knots]:
    """Schedules under which sources of short texts come earlier; at every time the weights add up to 1."""
    size = {s: math.log(max(m, 1.0)) for s, m in mean.items()}
    middle = sum(share[s] * size[s] for s in size)
    widest = max((abs(x - middle) for x in size.values()), default=0.0) or 1.0
    tilt = {s: strength * (x - middle) / widest for s, x in size.items()}
    return {s: [(0.0, 1 - tilt[s]), (1.0, 1 + tilt[s])] for s in size}


def mix(documents: DataFrame, targets: DataFrame, schedules: dict[str, Knots] | None = None, total_tokens: int | None = None, strength: float = 0.8, max_targets: int = 10_000) -> Mixture:
    """A mixture of ``documents`` (doc_id, source, n_tokens > 0) by ``targets`` (source, weight, max_repeats).

    A listed source without documents can give nothing; the others then share by their weights, and the report says
    so. Without ``total_tokens`` the mixture is the largest in which every other source holds its share with no text
    used more than ``max_repeats`` times. With it, a source that is too small gives all it may. A source's texts are
    used whole and equally often, but for a last round that takes as many, in a random order, as fit into the
    demand. Without ``schedules`` short texts come first (see ``strength``). Null sources and those not listed stay out;
    weights that are null or not positive count as not listed. Targets of equal spelling add up.
    """
    spark = documents.sparkSession
    listed: dict[str, tuple[float, int]] = {}
    got = targets.select(normalised_source(F.col("source")).alias("s"), "weight", "max_repeats").filter("s is not null and weight > 0").limit(max_targets + 1).collect()
    if len(got) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    for r in got:
        w, m = listed.get(r["s"], (0.0, 0))
        listed[r["s"]] = (w + r["weight"], max(m, r["max_repeats"] or 1))
    docs = durable(documents.select("doc_id", normalised_source(F.col("source")).alias("source"), "n_tokens").filter(F.col("source").isin(*listed) if listed else F.lit(False)), "mix")
    supply = {r["source"]: (r["t"], r["n"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # a row for each listed source
    weights = sum(w for w, _ in listed.values())
    present = sum(listed[s][0] for s in supply)
    share = {s: listed[s][0] / present for s in supply}
    largest = min((supply[s][0] * listed[s][1] / share[s] for s in supply), default=0)
    total = total_tokens if total_tokens is not None else int(largest)
    demand = {s: min(int(round(share[s] * total)), supply[s][0] * listed[s][1]) for s in supply}
    plan = schedules or _short_to_long({s: t / n for s, (t, n) in supply.items()}, share, strength)
    rows = [(s, d, d // supply[s][0], d % supply[s][0], listed[s][1], segments(plan[s])) for s, d in demand.items() if d > 0]
    kind = "source string, demand bigint, rounds bigint, rest bigint, max_repeats bigint, schedule array<struct<t0:double,t1:double,w0:double,slope:double,c0:double>>"
    want = F.broadcast(spark.createDataFrame(rows, kind))  # a row for each listed source, at most max_targets; so are the other tables by source
    # each round has an order of its own; the row's number, stable as it counts written rows, keeps copies of one row apart
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    copies = numbered.join(want, "source").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("rounds") + 1, F.col("max_repeats") - 1))))
    ordered = copies.select("source", "doc_id", "copy", "n_tokens", F.xxhash64("doc_id", "copy", "_row").alias("_at"))
    summed = durable(running_sum(ordered, ["source"], ["copy", "_at"], "n_tokens", "_sum").join(want.select("source", "demand", "schedule"), "source"), "mix-sums")
    taken = summed.filter(F.col("_sum") <= F.col("demand"))
    # What is left of a demand, less than the text after it, goes to the following texts that are no larger than it,
    # and at last to the largest that fits.
    gaps = summed.groupBy("source").agg((F.max("demand") - F.coalesce(F.max(F.when(F.col("_sum") <= F.col("demand"), F.col("_sum"))), F.lit(0))).alias("_gap"))
    small = summed.filter(F.col("_sum") > F.col("demand")).join(F.broadcast(gaps), "source").filter(F.col("n_tokens") <= F.col("_gap"))
    again = durable(running_sum(small, ["source"], ["_sum"], "n_tokens", "_more"), "mix-rest")
    more = again.filter(F.col("_more") <= F.col("_gap")).withColumn("_sum", F.col("demand") - F.col("_gap") + F.col("_more"))
    left = again.groupBy("source").agg((F.max("_gap") - F.coalesce(F.max(F.when(F.col("_more") <= F.col("_gap"), F.col("_more"))), F.lit(0))).alias("_left"))
    fits = again.filter(F.col("_more") > F.col("_gap")).join(F.broadcast(left), "source").filter(F.col("n_tokens") <= F.col("_left"))
    last = fits.groupBy("source", "demand", "schedule").agg(F.max(F.struct("n_tokens", "_at", "doc_id", "copy")).alias("x"))
    last = last.select("source", "x.doc_id", "x.copy", "x.n_tokens", "x._at", F.col("demand").alias("_sum"), "demand", "schedule")
    middle = (F.col("_sum") - F.col("n_tokens") / 2.0) / F.col("demand")
    placed = taken.unionByName(more.select(*taken.columns)).unionByName(last.select(*taken.columns)).withColumn("position", time_of(F.least(F.lit(1.0), middle), F.col("schedule")))
    mixture = placed.select("position", "source", "doc_id", "copy", "n_tokens")
    fixed = spark.createDataFrame([(s, w / weights, share.get(s, 0.0), supply.get(s, (0, 0))[0], m) for s, (w, m) in sorted(listed.items())], "source string, target_share double, planned_share double, supply_tokens bigint, max_repeats bigint")
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_texts"), (F.max("copy") + 1).alias("most_copies"))
    shares = fixed.join(F.broadcast(used), "source", "left").na.fill(0, ["tokens", "n_texts", "most_copies"])
    whole = shares.agg(F.sum("tokens").alias("_all"))  # one row
    shares = shares.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "planned_share", F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)).alias("reached_share"), "tokens", "n_texts", "most_copies", "supply_tokens", "max_repeats"
    )
    return Mixture(mixture.orderBy("position", "source", "doc_id", "copy"), shares)
