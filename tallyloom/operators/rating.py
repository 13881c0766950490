"""Pairwise ratings: battles, Bradley-Terry and online ratings, win rates, bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def battles(games: DataFrame, strong: int = 3) -> DataFrame:
    """(model_a, model_b, winner, weight) from (model_a, model_b, verdict, reversed); A>>B and B>>A weigh ``strong``.

    In a reversed game the verdict's A is model_b. Games without a verdict are dropped.
    """
    v = F.when(F.col("reversed"), F.translate("verdict", "AB", "BA")).otherwise(F.col("verdict"))
    # translated, 'A>B' reads 'B>A', that is: model_b won
    winner = F.when(v.isin("A>B", "A>>B"), "model_a").when(v.isin("B>A", "B>>A"), "model_b").when(v.isin("A=B", "B=A"), "tie")
    return games.select("model_a", "model_b", winner.alias("winner"), F.when(F.contains(v, F.lit(">>")), strong).otherwise(1).alias("weight")).filter("winner is not null")


def _solve(wins: np.ndarray, scale: float, base: float, start: float, rounds: int = 200) -> np.ndarray:
    """Ratings of the maximum-likelihood Bradley-Terry model; wins[i, j]: how often i beat j, ties half each."""
    n = len(wins)
    x = np.zeros(n)
    played = wins + wins.T
    step = math.log(base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-step * (x[:, None] - x[None, :])))
        gradient = step * (wins - played * p).sum(axis=1)
        h = step**2 * played * p * (1 - p)
        hessian = np.diag(h.sum(axis=1)) - h + 1e-9 * np.eye(n)
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        move = np.clip(move, -1, 1)
        x += move
        if np.abs(move).max() < 1e-10:
            break
    return scale * (x - x.mean()) + start


def pair_counts(fought: DataFrame) -> DataFrame:
    """(model_a, model_b, a, b, tie): battles reduced to one row for each ordered pair of models."""
    w = lambda x: F.sum(F.when(F.col("winner") == x, F.col("weight")).otherwise(0))
    return fought.groupBy("model_a", "model_b").agg(w("model_a").alias("a"), w("model_b").alias("b"), w("tie").alias("tie"))


def bradley_terry(fought: DataFrame, baseline: str | None = None, scale: float = 400.0, base: float = 10.0, start: float = 1000.0, max_models: int = 5_000) -> DataFrame:
    """(model, rating): the battles collapse to counts by pair on the executors; what reaches the driver is bounded by
    ``max_models`` squared, and more models are refused. If one side won every battle, the winner of the first pair
    gets ``scale`` more. The baseline, if it took part, stands at ``start``."""
    rows = pair_counts(fought).orderBy("model_a", "model_b").limit(max_models**2 + 1).collect()
    models = sorted({r["model_a"] for r in rows} | {r["model_b"] for r in rows})
    if len(models) > max_models:
        raise ValueError(f"more than {max_models} models")
    at = {m: i for i, m in enumerate(models)}
    wins = np.zeros((len(models), len(models)))
    for r in rows:
        i, j = at[r["model_a"]], at[r["model_b"]]
        wins[i, j] += r["a"] + r["tie"] / 2
        wins[j, i] += r["b"] + r["tie"] / 2
    sums = {k: sum(r[k] for r in rows) for k in ("a", "b", "tie")}
    if rows and not sums["tie"] and (not sums["a"] or not sums["b"]):
        rating = np.full(len(models), start)
        rating[at[rows[0]["model_a" if sums["a"] else "model_b"]]] += scale
    else:
        rating = _solve(wins, scale, base, start) if models else np.zeros(0)
        if baseline in at:
            rating = rating + start - rating[at[baseline]]
    return fought.sparkSession.createDataFrame([(m, float(rating[i])) for m, i in at.items()], "model string, rating double")


def win_rates(ratings: DataFrame, baseline: str, scale: float = 400.0, base: float = 10.0) -> DataFrame:
    """(model, win_rate): the chance to beat the baseline, rounded to 4 digits; the baseline's own is 0.5."""
    anchor = ratings.filter(F.col("model") == baseline).agg(F.max("rating").alias("_b"))  # one row
    rate = 1 / (1 + F.pow(F.lit(base), (F.col("_b") - F.col("rating")) / scale))
    return ratings.crossJoin(F.broadcast(anchor)).select("model", F.round(F.when(F.col("model") == baseline, 0.5).otherwise(rate), 4).alias("win_rate"))


def bootstrap_ratings(fought: DataFrame, rounds: int = 100, baseline: str | None = None, seed: int = 7) -> DataFrame:
    """(model, low, median, high): percentiles 2.5, 50 and 97.5 of ratings over resampled battles.

    Resampling draws, for each round, a Poisson number of copies of each battle; summed over a pair's battles that is
    again Poisson, so only the pair counts are needed, and each round is one task's small matrix.
    """
    counts = pair_counts(fought).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))

    def rate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed + int(key[0]))
        pdf = pdf.sort_values(["model_a", "model_b"])
        models = sorted(set(pdf["model_a"]) | set(pdf["model_b"]))
        at = {m: i for i, m in enumerate(models)}
        wins = np.full((len(models), len(models)), 1e-3)
        for a, b, x, y, t in zip(pdf["model_a"], pdf["model_b"], pdf["a"], pdf["b"], pdf["tie"], strict=True):
            x, y, t = rng.poisson([x, y, t])
            wins[at[a], at[b]] += x + t / 2
            wins[at[b], at[a]] += y + t / 2
        r = _solve(wins, 400.0, 10.0, 1000.0)
        if baseline in at:
            r = r + 1000.0 - r[at[baseline]]
        return pd.DataFrame({"round": key[0], "model": models, "rating": r})

    drawn = counts.groupBy("round").applyInPandas(rate, "round int, model string, rating double")
    return drawn.groupBy("model").agg(*[F.percentile("rating", F.lit(p)).alias(n) for p, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))])
