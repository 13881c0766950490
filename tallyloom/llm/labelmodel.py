"""An expectation-maximization label model over noisy labelling functions.

Each function votes on a record with a letter: 1 (defect), 0 (none), a letter of its own alphabet, or - (abstains); a
record's votes are a pattern such as ``10-1``. Patterns are counted where the data are, and only the counts reach the
driver: at most the product of the alphabets' sizes. The model is a two-class mixture in which the functions are
independent given the class, each letter with a probability of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Rates = list[float | dict[str, float]]


@dataclass
class Model:
    """``posterior`` of each pattern; by class, the last of which is no defect, ``shares`` and each function's ``rates``."""

    posterior: dict[str, float]
    shares: list[float]
    rates: list[list[dict[str, float]]]

    @property
    def prior(self) -> float:
        return 1 - self.shares[-1]


def _spread(rate: float | dict[str, float]) -> dict[str, float]:
    return rate if isinstance(rate, dict) else {"1": rate, "0": 1 - rate}


def estimate(patterns: dict[str, int], hit: Rates, false: Rates, prior: float = 0.05, anchor: float | list[float | None] = 0.02, rounds: int = 300, also: list[Rates] | None = None, least: float = 50.0) -> Model:
    """The model of the counted patterns.

    ``hit`` and ``false`` are the functions' expected rates of each letter (of voting 1, where a number) with and
    without the defect; ``also`` are those of further kinds of the defect, as what shows one may not show another. They
    start the model and hold it, as if seen on ``anchor`` times the rows (of each function, where a list) and ``least`` rows
    at least, so that the classes keep their meaning; an anchor of None fixes a function's rates. Abstentions and letters without a rate tell nothing. No patterns give no posteriors.
    """
    sides = [[_spread(x) for x in side] for side in (hit, *(also or []), false)]
    kinds = len(sides) - 1
    shares = np.array([prior / kinds] * kinds + [1 - prior])
    if not patterns:
        return Model({}, shares.tolist(), sides)
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    letters = [sorted(set().union(*(side[j] for side in sides))) for j in range(len(hit))]
    shown = [np.array([[float(p[j] == x) for x in xs] for p in names]) for j, xs in enumerate(letters)]  # pattern by letter
    rates = [[np.maximum([side[j].get(x, 0.0) for x in xs], 1e-5) for j, xs in enumerate(letters)] for side in sides]
    rates = [[r / r.sum() for r in side] for side in rates]
    begun = [[r.copy() for r in side] for side in rates]
    anchors = anchor if isinstance(anchor, list) else [anchor] * len(hit)
    held = [np.maximum((a or 0.0) * n.sum() * np.array([prior / kinds] * kinds + [1.0]), least) for a in anchors]
    post = np.zeros((len(n), len(sides)))
    for _ in range(rounds):
        z = np.stack([np.log(p) + sum(v @ np.log(r) for v, r in zip(shown, side, strict=True)) for p, side in zip(shares, rates, strict=True)], 1)
        new = np.exp(z - z.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        for c in range(len(sides)):
            for j, v in ((j, v) for j, v in enumerate(shown) if anchors[j] is not None):
                seen = (n * new[:, c]) @ v + held[j][c] * begun[c][j]
                rates[c][j] = np.maximum(seen / seen.sum(), 1e-5)
        shares = (n @ new + least * np.array([prior / kinds] * kinds + [1 - prior])) / (n.sum() + least)
        shares[-1] = max(shares[-1], 0.4)
        shares /= shares.sum()
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done:
            break
    named = [[dict(zip(xs, r.tolist(), strict=True)) for xs, r in zip(letters, side, strict=True)] for side in rates]
    return Model(dict(zip(names, (1 - post[:, -1]).tolist(), strict=True)), shares.tolist(), named)


def fit(patterns: dict[str, int], hit: Rates, false: Rates, **settings) -> dict[str, float]:
    """Each pattern's posterior of a defect; see estimate()."""
    return estimate(patterns, hit, false, **settings).posterior


def score(model: Model, pattern: str) -> float:
    """The posterior of any pattern, also of one that the model hasn't seen."""
    if pattern in model.posterior:
        return model.posterior[pattern]
    z = np.array([np.log(p) + sum(np.log(r.get(x, 1e-5)) for x, r in zip(pattern, side, strict=True) if r and x != "-") for p, side in zip(model.shares, model.rates, strict=True)])
    e = np.exp(z - z.max())
    return float(1 - e[-1] / e.sum())


def cutoff(patterns: dict[str, int], posterior: dict[str, float], least: float = 0.5, most: float = 0.95) -> float:
    """The posterior from which on patterns count: the F1 that the posteriors themselves expect is highest."""
    best, at = -1.0, least
    whole = sum(n * posterior[p] for p, n in patterns.items())
    for c in sorted({min(most, max(least, x)) for x in posterior.values()} | {least}):
        chosen = [p for p in patterns if posterior[p] >= c]
        n, right = sum(patterns[p] for p in chosen), sum(patterns[p] * posterior[p] for p in chosen)
        f1 = 2 * right / (n + whole) if n + whole else 0.0
        if f1 > best + 1e-12:
            best, at = f1, c
    return at


def validated_cutoff(patterns: dict[str, int], model: Model, planted: dict[str, int], least: float = 0.2, most: float = 0.95) -> float:
    """The cutoff validated on labelled records: ``planted`` counts the patterns of records known to have the defect.

    A cutoff's recall is measured on them; with the share that the model finds in the data it says how many of the
    chosen records can be right, and so the F1. Of equal ones the middle of the widest gap counts. Without planted
    records it is cutoff().
    """
    known = sum(planted.values())
    if not known or not patterns:
        return cutoff(patterns, model.posterior)
    total = sum(patterns.values())
    grid = sorted({min(most, max(least, x)) for x in [*model.posterior.values(), least, most]})
    scored, found = [], {p: score(model, p) for p in planted}
    for low, high in zip([least, *grid], [*grid, most], strict=True):
        at = (low + high) / 2
        recall = sum(n for p, n in planted.items() if found[p] >= at) / known
        chosen = sum(n for p, n in patterns.items() if model.posterior[p] >= at) / total
        right = min(chosen, recall * model.prior)
        scored.append((round(2 * right / (chosen + model.prior), 4), high - low, at))
    return max(scored)[2]
