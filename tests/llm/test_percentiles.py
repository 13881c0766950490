import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import percentiles as P


def state(df):
    return P.value_counts(df, {"g": F.col("g"), "day": F.col("day")}, {"x": F.col("x")})


def brute(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v) / 100)) - 1]


def test_percentiles_within_the_error_and_mergeable(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(3)}", rng.randrange(4), rng.choice([0.0, rng.lognormvariate(2, 2), float(rng.randrange(900))]), 1) for _ in range(4000)]
    rows += [("hot", 1, None, 1), ("hot", 1, float("nan"), 1), (None, 2, 5.0, 1), ("inf", 1, float("inf"), 1), ("inf", 1, -3.21456, 1)]
    df = spark.createDataFrame(rows, "g string, day int, x double, n int")
    got = {(r["g"], r["p"]): r for r in P.percentiles(P.merge(state(df), ["g"]), ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [x for h, _, x, _ in rows if h == g and x is not None and not math.isnan(x)]
        for p in P.PERCENTS:
            want, r = brute(values, p), got[g, p]
            assert r["n"] == len(values)
            assert r["value"] == want or abs(r["value"] - want) <= r["max_rel_error"] * abs(want) * 1.0001
    odd, even = state(df.filter("day % 2 = 1")), state(df.filter("day % 2 = 0"))
    again = {(r["g"], r["p"]): r["value"] for r in P.percentiles(P.merge(odd.unionByName(even), ["g"]), ["g"]).collect()}
    assert again == {k: r["value"] for k, r in got.items()}


def test_small_integers_are_exact_and_states_are_small(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.lit(1).alias("day"), (F.col("id") % 997).cast("double").alias("x"))
    s = state(df)
    assert s.count() == 997
    assert {r["p"]: r["value"] for r in P.percentiles(P.merge(s, ["g"]), ["g"]).collect()}[50.0] == brute([i % 997 for i in range(20_000)], 50)
    wide = spark.range(50_000).select(F.lit("a").alias("g"), F.lit(1).alias("day"), F.exp(F.col("id") / 2500.0).alias("x"))
    assert state(wide).count() <= 900 * 10
    assert P.percentiles(P.merge(s.limit(0), ["g"]), ["g"]).count() == 0
    assert P.max_relative_error(3) == pytest.approx(0.005)
