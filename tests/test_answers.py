import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import answers as A


@pytest.mark.parametrize(
    "text, want",
    [("so \\boxed{\\frac{1}{2}}.", "1/2"), ("\\boxed{a{b}c} and \\boxed{3}", "3"), ("The answer is 1,234.", "1234"), ("ANSWER: B", "B"), ("I got 3 and then 4.50", "4.50"), ("nothing", ""), (None, ""), ("\\boxed{5", "5"), ("答案是 12。", "12")],
)
def test_extracted(text, want):
    assert A.extracted(text) == want


@pytest.mark.parametrize(
    "a, b, same",
    [("0.5", "\\frac{1}{2}", True), ("50%", "0.5", True), ("1,000", "1000", True), ("(1, 2)", "(1,2.0)", True), ("(1,2)", "(2,1)", False), ("The option is C", "C", True), ("x=3", "3", True), ("2\\sqrt{3}", "3.4641", True), ("seven", "7", True), ("abc", "abd", False), (None, "1", False), ("3 cm", "3", True)],
)
def test_equal(a, b, same):
    assert A.equal(a, b) is same


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment(score):
    n = len(score)
    assert A._assign(score) == max(sum(score[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_spans_and_bags():
    tags = A.tags_of("Ann Lee met Bob in Rome".split(), "<person>Ann Lee</person> met <person>Bob</person> in <place>Rome</place> <place>Oslo</place>")
    assert tags == ["B-PERSON", "I-PERSON", "O", "B-PERSON", "O", "B-PLACE"]
    assert A.entities(tags) == {("PERSON", 0, 2), ("PERSON", 3, 4), ("PLACE", 5, 6)}
    assert A.bag_f1(["the cat", "dog"], ["dog", "a cat"]) == 1.0 and A.bag_f1(["12 men"], ["13 men"]) == 0.0 and A.bag_f1([], []) == 0.0
    assert A.greedy_distinct([[1, 0], [1, 0.1], [0, 1]]) == [0, 2]
    assert A.near_duplicate("Hold the door open", "hold door open!") and not A.near_duplicate("Hold a door", "Sell the car")
    for a, b, same in [("hold door", "hold door open with a brick wedge outside", False), ("!!", "??", False), ("Prop doors open", "prop the door open", True), ("stir paint", "stir thick paint", True), ("paint", "paint walls", False), ("berries", "the berry", True)]:
        assert A.near_duplicate(a, b) is same, (a, b)
    assert A.new_ideas(["Stir paint", "stir the paints", " ", "Dig a hole"], ["dig holes"]) == ["Stir paint"] and A.new_ideas(None) == []
    assert A.bag_f1(["7"], ["7.0"]) == 1.0 and A.bag_f1(["u.s. army"], ["us army"]) == 1.0


def test_plain(spark):
    df = spark.createDataFrame([("Ｈéllo [noise] (aside), Wörld!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(A.plain(F.col("t"))).collect()] == ["héllo wörld", None, ""]


def test_columns(spark):
    df = spark.createDataFrame([("\\boxed{2}", "2.0", ["x"]), (None, None, None)], "p string, r string, a array<string>")
    rows = df.select(A.extract_answer(F.col("p")).alias("e"), A.math_equal(F.col("p"), F.col("r")).alias("m"), A.drop_f1(F.col("a"), F.col("a")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("2", 0.0, 1.0), ("", 0.0, 0.0)]
    b = spark.createDataFrame([("k", "a b c d e", "a b c d e"), ("k", "a b c d", "a b c d x")], "k string, p string, r string")
    assert 0.5 < A.corpus_bleu(b, F.col("p"), F.col("r"), ["k"]).first()["bleu"] < 1


def test_entity_and_character_scores(spark):
    from tallyloom.operators import spans

    df = spark.createDataFrame([("x", ["B-P", "I-P", "O"], ["B-P", "I-P", "B-L"]), ("x", ["B-P"], None), ("y", None, None)], "k string, g array<string>, p array<string>")
    got = {(r["k"], r["type"]): (r["tp"], r["n_gold"], r["n_predicted"]) for r in spans.entity_scores(df, ["k"], "g", "p").collect()}
    assert got == {("x", "P"): (1, 2, 1), ("x", "L"): (0, 0, 1), ("x", "all"): (1, 2, 2)}
    t = spark.createDataFrame([("a", "same text", "same text"), ("b", "abc", "xyz"), ("c", None, "x")], "k string, p string, r string")
    assert {r["k"]: round(r["chrf"], 6) for r in spans.corpus_chrf(t, ["k"], "p", "r").collect()} == {"a": 100.0, "b": 0.0, "c": 0.0}


def test_ideas(spark):
    from tallyloom.operators import clustering

    pool = spark.createDataFrame([(i, [float(i % 2) * 10 + (i % 5) * 0.1, 0.0]) for i in range(80)], "vec_id int, embedding array<double>")
    ideas = spark.createDataFrame([("s", [0.2, 0.0]), ("s", [10.2, 0.0]), ("s", [100.0, 0.0]), ("t", None)], "sample string, embedding array<double>")
    got = clustering.idea_scores(ideas, pool, "sample").collect()
    assert len(got) == 1 and got[0]["n"] == 3 and got[0]["originality"] > 10 and got[0]["flexibility"] == pytest.approx((2 + 3) / 3**0.5)
