"""Consensus labels, agreement and annotator reliability from disagreeing votes.

Method: iteratively reweighted voting. Weighted consensus and leave-one-out smoothed annotator accuracy alternate
until stable. An annotator is measured by each item's *other* votes only, so nobody confirms themselves; the
accuracy is kept for each true label, so that an annotator who always says the same, or the opposite, weighs what
the vote is worth. Agreement is Krippendorff's alpha, which allows for missing ratings.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import durable

# The wordings of a verdict.
_YES_NO = {"yes": "YES", "true": "YES", "是": "YES", "no": "NO", "false": "NO", "否": "NO"}
_LEVELS = {"low": "LOW", "低": "LOW", "medium": "MEDIUM", "中": "MEDIUM", "high": "HIGH", "高": "HIGH"}
_KEYS = "verdict|decision|label|answer|result|judgment|judgement"
_LEADS = "verdict|decision|final answer|answer|判定|结论|答案"
_CHOICES = "evidence supports|i choose|i pick|i conclude|i decide on"


def _stated(text: Column, words: dict[str, str]) -> Column:
    one = f"({'|'.join(words)})(?:[^a-z一-鿿]|$)"
    t = F.regexp_replace(text, r"(?is)<think>.*?</think>", " ")
    forms = [
        rf'(?i)"(?:{_KEYS})"\s*:\s*"?{one}',
        rf"(?i)<answer>\s*{one}\s*</answer>",
        rf"(?i)\[\[\s*{one}\s*\]\]",
        rf"(?i)(?:{_LEADS})(?: is)?[^\w一-鿿]{{1,6}}(?:is )?{one}",
        rf"(?i)(?:{_CHOICES}) {one}",
        rf"(?i)^[^\w一-鿿]*{one}",
    ]
    found = F.coalesce(*[F.when((m := F.regexp_extract(t, p, 1)) != "", m) for p in forms])
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.element_at(table, F.lower(found))


def stated_label(stage: Column, text: Column) -> Column:
    """The label that a judge's answer states, or null: LOW, MEDIUM or HIGH in stage ``novelty``, else YES or NO.

    What stands in a <think> block is no verdict. Named fields, tags and phrases of a decision come before a word at
    the beginning. A text that names both labels without deciding has none.
    """
    return F.when(stage == "novelty", _stated(text, _LEVELS)).otherwise(_stated(text, _YES_NO))


def usable_votes(answers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(sample_key, stage, judge, label): each judge's latest usable vote on a sample and stage.

    Usable: status ``success``, a judge known by ``aliases``, a stated label. Of equal ``updated_at`` the higher
    ``vote_id`` counts; null ``updated_at`` comes first. Votes without a sample or stage belong to no item.
    """
    known = aliases.filter("judge_key is not null and judge is not null").groupBy(F.col("judge_key").alias("_key")).agg(F.min("judge").alias("judge"))
    parsed = (
        answers.filter("status = 'success' and sample_key is not null and stage is not null and judge_key is not null")
        .select("sample_key", "stage", F.col("judge_key").alias("_key"), "updated_at", "vote_id", stated_label(F.col("stage"), F.col("raw_judge_response")).alias("label"))
        .filter("label is not null")
    )
    latest = F.max_by("label", F.struct("updated_at", "vote_id"))
    return parsed.join(known, "_key").groupBy("sample_key", "stage", "judge").agg(latest.alias("label"))


@dataclass
class Consensus:
    """``items``: sample_key, stage, kind, votes, consensus_label, confidence, agreement, n_votes.
    ``judges``: kind, judge, true_label, label, rate (how often the judge says label where true_label holds), accuracy, n_votes.
    ``rounds``: iterations made; ``stable``: whether the last one changed no rate by the tolerance."""

    items: DataFrame
    judges: DataFrame
    rounds: int
    stable: bool


def _labels(kind: str) -> list[str]:
    return ["LOW", "MEDIUM", "HIGH"] if kind == "levels" else ["NO", "YES"]


def reweighted_consensus(votes: DataFrame, min_votes: int = 3, prior: float = 2.0, tolerance: float = 1e-3, max_rounds: int = 60, max_judges: int = 10_000) -> Consensus:
    """Consensus of the items with at least ``min_votes`` votes; one vote a judge and item, as usable_votes() gives.

    Items are first reduced to distinct sets of votes with their counts, so a round's cost follows the number of
    different vote sets, not of items, and votes are numbered, so that a vote's rates are one array access. A round's only result on the driver is one row for each judge and pair of
    labels; ``max_judges`` bounds it, and more judges are refused. An item's list of votes holds one vote a judge.
    Smoothing adds ``prior`` votes of a judge of average accuracy. Ties go to the label first in order. No votes at
    all give empty results.
    """
    spark = votes.sparkSession
    kind = F.when(F.col("stage") == "novelty", "levels").otherwise("binary")
    items = (
        votes.groupBy("sample_key", "stage").agg(F.array_sort(F.collect_list(F.struct("judge", "label"))).alias("votes")).filter(F.size("votes") >= min_votes).withColumn("kind", kind)
    )
    items = durable(items, "items")
    sets = durable(items.groupBy("kind", "votes").agg(F.count("*").alias("n")), "vote-sets")
    members = sets.select("kind", F.explode("votes.judge").alias("judge")).distinct().orderBy("kind", "judge").limit(max_judges + 1).collect()
    if len(members) > max_judges:
        raise ValueError(f"more than {max_judges} judges")
    sets = durable(_coded(sets, members), "coded-sets")
    kinds = {k: _labels(k) for k in ("binary", "levels")}
    # a judge starts as somewhat better than chance, alike for all
    rates = {(m["kind"], m["judge"], t, v): (0.7 if t == v else 0.3 / (len(kinds[m["kind"]]) - 1)) for m in members for t in kinds[m["kind"]] for v in kinds[m["kind"]]}
    share = {(k, t): 1 / len(ls) for k, ls in kinds.items() for t in ls}
    counts: dict[tuple, float] = {}
    rounds = 0
    stable = not members
    while not stable and rounds < max_rounds:
        rounds += 1
        counts, sure, share = _round(sets, members, rates, share, kinds)
        new = _accuracies(counts, sure, rates, kinds, prior)
        change = max(abs(new[x] - rates[x]) for x in rates)
        rates = new
        stable = change < tolerance
    rows = []
    for (k, j, t, v), r in sorted(rates.items()):
        held = {a: sum(counts.get((k, j, a, b), 0.0) for b in kinds[k]) for a in kinds[k]}
        n = sum(held.values())
        accuracy = sum(held[a] * rates[k, j, a, a] for a in held) / n if n else rates[k, j, t, t]
        rows.append((k, j, t, v, float(r), float(accuracy), float(n)))
    judges = spark.createDataFrame(rows, "kind string, judge string, true_label string, label string, rate double, accuracy double, n_votes double")
    return Consensus(_decide(items, sets, members, rates, share, kinds), judges, rounds, stable)


def _coded(sets: DataFrame, members: list) -> DataFrame:
    """``sets`` with ``codes``: each vote as three times its judge's number plus its label's."""
    spark = sets.sparkSession
    rows = [(m["kind"], m["judge"], v, 3 * i + l) for i, m in enumerate(members) for l, v in enumerate(_labels(m["kind"]))]
    index = spark.createDataFrame(rows, "kind string, judge string, label string, code int")  # three rows a judge, bounded by max_judges
    numbered = durable(sets.withColumn("sid", F.monotonically_increasing_id()), "numbered-sets")
    votes = numbered.select("sid", "kind", F.explode("votes").alias("x")).select("sid", "kind", "x.judge", "x.label")
    codes = votes.join(F.broadcast(index), ["kind", "judge", "label"]).groupBy("sid").agg(F.collect_list("code").alias("codes"))
    return numbered.join(codes, "sid").drop("sid")


def _weights(members: list, rates: dict, kinds: dict) -> Column:
    """All votes' log rates as one constant, three for each code; labels that a kind lacks can't be."""
    flat = []
    for m in members:
        ls = kinds[m["kind"]]
        for v in (*ls, *[None] * (3 - len(ls))):
            flat += [math.log(rates[m["kind"], m["judge"], ls[t], v]) if v and t < len(ls) else -1e3 for t in range(3)]
    return F.from_json(F.lit(json.dumps(flat)), "array<double>")


def _start(kind: Column, share: dict, kinds: dict) -> Column:
    logs = lambda k, ls: [math.log(max(share[k, t], 1e-6)) for t in ls] + [-1e3] * (3 - len(ls))
    return F.element_at(F.create_map(*[x for k, ls in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, logs(k, ls))))]), kind)


def _own(code: Column, weights: Column) -> Column:
    """A vote's log rates for the labels."""
    return F.slice(weights, code * 3 + 1, 3)


def _scores(weights: Column, share: dict, kinds: dict) -> Column:
    """The labels' log weights by all votes of a row."""
    return F.aggregate("codes", _start(F.col("kind"), share, kinds), lambda s, c: F.zip_with(s, _own(c, weights), lambda a, b: a + b))


def _softmax(scores: Column) -> Column:
    e = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    whole = lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, b: a + b))
    return F.transform(F.array(e(scores)), whole)[0]


def _round(sets: DataFrame, members: list, rates: dict, share: dict, kinds: dict) -> tuple[dict, dict, dict]:
    """Leave-one-out sums over all votes, on the driver: one row for each kind, judge and label.

    The first is by (kind, judge, true label, label), the second by (kind, judge, label, label) holds the products of
    the labels' shares, which tell how far the others' consensus itself is sure. The third has each label's share.
    """
    weights = _weights(members, rates, kinds)
    scored = sets.select("kind", "n", "codes", _scores(weights, share, kinds).alias("_s"))
    # the code -1 stands for the consensus of all votes
    each = scored.select("kind", "n", "_s", F.explode(F.concat("codes", F.array(F.lit(-1)))).alias("code"))
    others = F.when(F.col("code") < 0, F.col("_s")).otherwise(F.zip_with("_s", _own(F.greatest("code", F.lit(0)), weights), lambda a, b: a - b))
    p = each.select("kind", "code", "n", _softmax(others).alias("p"))
    sums = [F.sum(F.col("n") * F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)]
    sums += [F.sum(F.col("n") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"q{i}{j}") for i in range(3) for j in range(3)]
    counts, sure, whole = {}, {}, {}
    for r in p.groupBy("kind", "code").agg(*sums).collect():
        k, code = r["kind"], r["code"]
        for a, t in enumerate(kinds[k]):
            if code < 0:
                whole[k, t] = r[f"p{a}"]
                continue
            j, v = members[code // 3]["judge"], kinds[k][code % 3]
            counts[k, j, t, v] = r[f"p{a}"]
            for b, u in enumerate(kinds[k]):
                sure[k, j, t, u] = sure.get((k, j, t, u), 0.0) + r[f"q{a}{b}"]
    shares = {(k, t): (whole.get((k, t), 0.0) + 1) / (sum(whole.get((k, u), 0.0) for u in ls) + len(ls)) for k, ls in kinds.items() for t in ls}
    return counts, sure, shares


def _accuracies(counts: dict, sure: dict, before: dict, kinds: dict, prior: float) -> dict:
    """New rates by (kind, judge, true label, label) from a round's sums.

    As the others' consensus is wrong at times, a judge's agreement with it understates the judge. The products of
    the consensus's own shares say how it mixes the true labels; solving for them undoes the mixing.
    """
    rates = {}
    for k, j in sorted({(k, j) for k, j, *_ in before}):
        ls = kinds[k]
        n = np.array([[counts.get((k, j, t, v), 0.0) for v in ls] for t in ls])
        mix = np.array([[sure.get((k, j, t, u), 0.0) for u in ls] for t in ls])
        typical = np.where(np.eye(len(ls)) == 1, 0.7, 0.3 / (len(ls) - 1))
        solved = np.clip(np.linalg.lstsq(mix.T + 1e-9 * np.eye(len(ls)), n, rcond=None)[0], 1e-3, None)
        solved = solved / solved.sum(axis=1, keepdims=True)
        held = n.sum(axis=1, keepdims=True)
        smooth = np.clip((solved * held + prior * typical) / (held + prior), 1e-3, 1 - 1e-3)
        rates |= {(k, j, t, v): float(smooth[a, b]) for a, t in enumerate(ls) for b, v in enumerate(ls)}
    return rates


def _decide(items: DataFrame, sets: DataFrame, members: list, rates: dict, share: dict, kinds: dict) -> DataFrame:
    """Each different set of votes is decided once, and its items take the label over."""
    labels = F.create_map(*[x for k, ls in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, ls)))])
    scored = sets.select("kind", "votes", _softmax(_scores(_weights(members, rates, kinds), share, kinds)).alias("_p"))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    decided = scored.select("kind", "votes", F.element_at(F.element_at(labels, F.col("kind")), best).alias("consensus_label"), F.array_max("_p").alias("confidence"))
    return items.join(decided, ["kind", "votes"], "left").select("sample_key", "stage", "kind", "votes", "consensus_label", "confidence", _pairwise(F.col("votes.label")).alias("agreement"), F.size("votes").alias("n_votes"))


def _pairwise(labels: Column) -> Column:
    """The share of pairs of votes that agree."""
    n = F.size(labels)
    same = F.aggregate(F.array_distinct(labels), F.lit(0.0), lambda s, v: s + (lambda c: c * (c - 1))(F.size(F.filter(labels, lambda x: x == v))))
    return same / (n * (n - 1))


def krippendorff_alpha(votes: DataFrame, groups: list[str], item: list[str], label: str = "label") -> DataFrame:
    """(*groups, n_items, n_votes, observed, expected, alpha): nominal alpha over the items with two votes or more.

    Disagreement within items against that by chance, with each item's votes weighted by 1/(m-1), as fits missing
    ratings. Null labels are no ratings. Where chance leaves no disagreement (one label only), alpha is null.
    """
    per = votes.filter(F.col(label).isNotNull()).groupBy(*groups, *item, label).agg(F.count("*").alias("c"))
    unit = per.groupBy(*groups, *item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).filter("m >= 2")
    within = unit.groupBy(*groups).agg(F.count("*").alias("n_items"), F.sum("m").alias("n_votes"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("_within"))
    kept = per.join(unit.select(*groups, *item), [*groups, *item], "left_semi")
    totals = kept.groupBy(*groups, label).agg(F.sum("c").alias("c")).groupBy(*groups).agg(F.sum(F.col("c") * F.col("c")).alias("_sq"))
    n = F.col("n_votes")
    return within.join(totals, groups).select(
        *groups, "n_items", "n_votes", (F.col("_within") / n).alias("observed"), ((n * n - F.col("_sq")) / (n * (n - 1))).alias("expected"),
        (1 - F.try_divide(F.col("_within") / n, (n * n - F.col("_sq")) / (n * (n - 1)))).alias("alpha"),
    )
