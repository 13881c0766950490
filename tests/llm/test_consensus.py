import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import consensus

VOTES = "vote_id bigint, sample_key string, stage string, judge_key string, status string, raw_judge_response string, updated_at timestamp, judge string"


def test_stated_label(spark):
    cases = [("x", "YES", "YES"), ("x", "<answer>no</answer>", "NO"), ("x", '{"verdict": true, "notes": "no"}', "YES"), ("x", '{"judge_notes": {"text": "yes"}, "result": {"label": "No"}}', "NO"), ("x", "判定:是。在这", "YES"),
             ("x", "Options were NO / YES. Maybe.\nI choose NO.", "NO"), ("x", "At first I leaned towards NO. On reflection my final answer is YES.", "YES"), ("x", "<think>Could it be NO?</think>\nYES", "YES"), ("x", "Both YES and NO are defensible here.", None),
             ("x", '{"verdict": null}', None), ("x", '{"verdict": ', None), ("x", "   ", None), ("x", None, None), ("x", "判定:无法判断。", None), ("novelty", "Verdict — medium\nblah", "MEDIUM"), ("novelty", "YES", None), ("x", "no" * 100_000, None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(cases)], "i int, s string, t string")
    got = {r["i"]: r["l"] for r in df.select("i", consensus.stated_label(F.col("s"), F.col("t")).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_usable_votes(spark):
    rows = [(1, "k", "s", "a", "success", "YES", None, "clash"), (2, "k", "s", "A", "success", "NO", None, "clash"), (3, "k", "s", "a", "failed", "YES", None, None), (4, "k", "s", "zz", "success", "YES", None, None), (5, None, "s", "a", "success", "YES", None, None), (6, "k", None, "a", "success", "YES", None, None), (7, "k", "s", None, "success", "YES", None, None)]
    aliases = spark.createDataFrame([("a", "a"), ("A", "a"), ("A", "a"), (None, "b"), ("c", None)], "judge_key string, judge string")
    got = consensus.usable_votes(spark.createDataFrame(rows, VOTES), aliases).collect()
    assert [(r["sample_key"], r["stage"], r["judge"], r["label"]) for r in got] == [("k", "s", "a", "NO")]
    assert consensus.usable_votes(spark.createDataFrame([], VOTES), aliases).count() == 0


def test_consensus_finds_the_truth_behind_unlike_judges(spark):
    """Good judges, one that always agrees, one at random and one that says the opposite: better than the majority."""
    rng = random.Random(5)
    rates = {"g1": (0.93, 0.93), "g2": (0.9, 0.92), "g3": (0.88, 0.86), "yes": (0.03, 0.99), "coin": (0.5, 0.5), "anti": (0.15, 0.15), "anti2": (0.2, 0.2)}
    truth, rows, naive = {}, [], 0
    for i in range(800):
        t = rng.random() < 0.5
        truth[f"k{i}"] = "YES" if t else "NO"
        said = {j: (t if rng.random() < rates[j][t] else not t) for j in rng.sample(sorted(rates), 5)}
        rows += [(f"k{i}", "s", j, "YES" if v else "NO") for j, v in said.items()]
        naive += (sum(said.values()) >= 3) == t
    rows += [("few", "s", "g1", "YES"), ("few", "s", "g2", "YES")]
    c = consensus.reweighted_consensus(spark.createDataFrame(rows, "sample_key string, stage string, judge string, label string"))
    items = {r["sample_key"]: r for r in c.items.collect()}
    assert "few" not in items and len(items) == 800
    right = sum(items[k]["consensus_label"] == v for k, v in truth.items())
    assert right > 0.88 * 800 and right > naive + 50
    rate = {(r["judge"], r["true_label"]): r["rate"] for r in c.judges.collect() if r["true_label"] == r["label"]}
    assert rate["anti", "YES"] < 0.35 and rate["g1", "NO"] > 0.85 and rate["yes", "YES"] > 0.9
    assert all(0 <= r["confidence"] <= 1 and 0 <= r["agreement"] <= 1 for r in items.values())


def test_consensus_of_nothing_and_ties(spark):
    kind = "sample_key string, stage string, judge string, label string"
    assert consensus.reweighted_consensus(spark.createDataFrame([], kind)).items.count() == 0
    tie = spark.createDataFrame([("k", "novelty", "a", "LOW"), ("k", "novelty", "b", "MEDIUM"), ("k", "novelty", "c", "HIGH")], kind)
    assert consensus.reweighted_consensus(tie).items.count() == 1


def test_alpha(spark):
    """The textbook nominal example with missing ratings: alpha 0.743."""
    data = {"a": "1231221451**", "b": "122322145*53", "c": "*33322215131"[:12], "d": "1123" + "221451*2"[:8]}
    rows = [(f"u{i}", j, x) for j, s in data.items() for i, x in enumerate(s) if x != "*"] + [("u0", "z", None)]
    v = spark.createDataFrame([("g", *r) for r in rows], "g string, sample_key string, judge string, label string")
    r = consensus.krippendorff_alpha(v, ["g"], ["sample_key"]).first()
    by = {}
    for u, _, x in rows:
        if x:
            by.setdefault(u, []).append(x)
    pairs = [u for u in by.values() if len(u) > 1]
    n = sum(map(len, pairs))
    do = sum(sum(a != b for i, a in enumerate(u) for k, b in enumerate(u) if i != k) / (len(u) - 1) for u in pairs) / n
    flat = [x for u in pairs for x in u]
    de = sum(a != b for i, a in enumerate(flat) for k, b in enumerate(flat) if i != k) / n / (n - 1)
    assert r["alpha"] == pytest.approx(1 - do / de)
    same = spark.createDataFrame([("g", "u", j, "x") for j in "ab"], "g string, sample_key string, judge string, label string")
    assert consensus.krippendorff_alpha(same, ["g"], ["sample_key"]).first()["alpha"] is None
