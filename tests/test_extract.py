import pytest
from pyspark.sql import functions as F

from tallyloom.functions import extract, scoring, text
from tallyloom.operators import aggregate, sampling


def values(spark, rows, kind, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kind).select(*columns).collect()]


def test_code_and_json(spark):
    t = ["a\n```python\nx = 1\n\n```\n```sql\nSELECT 1\n```", "```\ny = 2", "no code", None, "", '{"a": 1}', 'so <answer>[1, 2]</answer> it is', 'well, {"b": {"c": 2}} and more', "{broken", "```json\n{\"d\": 3}\n```"]
    got = values(spark, [(x,) for x in t], "t string", extract.fenced_code(F.col("t")), extract.fenced_code(F.col("t"), "SQL"), extract.lenient_json(F.col("t")))
    assert [g[0] for g in got] == ["x = 1", "y = 2", None, None, None, None, None, None, None, '{"d": 3}']
    assert got[0][1] == "SELECT 1" and got[1][1] == "y = 2"
    assert [g[2] for g in got] == [None, None, None, None, None, '{"a": 1}', "[1, 2]", '{"b": {"c": 2}}', None, '{"d": 3}']


def test_choices(spark):
    t = ["答案：A", "**答案**: ", "所以 答案: B，A,", "答案:AZ", None]
    assert [g[0] for g in values(spark, [(x,) for x in t], "t string", extract.chosen_letters_zh(F.col("t")))] == [["A"], None, ["A", "B"], [], None]
    rows = [(i, ["w", "x", "y", "z"], i % 5) for i in range(40)]
    got = values(spark, rows, "id int, c array<string>, t int", extract.shuffled_choices(F.col("c"), F.col("t"), F.col("id"))["choices"], extract.shuffled_choices(F.col("c"), F.col("t"), F.col("id"))["target"])
    for (_, c, t), (s, at) in zip(rows, got, strict=True):
        assert sorted(s) == c and (s[at] == c[t] if t < 4 else at is None)
    assert len({tuple(s) for s, _ in got}) > 5


def test_tool_calls(spark):
    kind = "p struct<plan:string,action:string,arguments:map<string,string>>, e struct<plan:string,action:string,arguments:map<string,string>>"
    rows = [(("call", "f", {"a": "1", "b": "2"}), ("call", "f", {"a": "1", "b": "3", "c": "4"})), (("call", "g", {}), ("call", "f", {})), (("call", "f", None), ("call", "f", {})), (("finish", None, None), ("call", "f", {"a": "1"})), ((None, None, None), (None, None, None))]
    got = values(spark, rows, kind, extract.tool_call_scores(F.col("p"), F.col("e"), F.array(F.lit("f"))).alias("s"))
    assert [tuple(g[0]) for g in got] == [(1.0, 1.0, pytest.approx(0.6), 0.0), (1.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 0.0)]
    calls = ['{"q": "x", "n": 3}', '{"q": 3}', '{"n": 2}', '{"q": "x", "z": 1}', "[1]", "nothing", None]
    assert [g[0] for g in values(spark, [(c,) for c in calls], "c string", extract.call_fits(F.col("c"), {"q": ("string", True), "n": ("number", False)}))] == [True, False, False, False, False, False, False]


def test_words_of_any_script(spark):
    t = ["Él comió 3 piñas", "今天天气很好", "a-b_c", None, " "]
    assert [g[0] for g in values(spark, [(x,) for x in t], "t string", text.words(F.col("t")))] == [["él", "comió", "3", "piñas"], list("今天天气很好"), ["a", "b", "c"], [], []]
    assert values(spark, [("今天天气很好", "今天天气不好")], "a string, b string", scoring.word_error_rate(F.col("a"), F.col("b")))[0][0] == pytest.approx(1 / 6)
    assert values(spark, [("a b\nc d", "a b x\nd")], "a string, b string", scoring.rouge_l_sum(F.col("a"), F.col("b")))[0][0] == pytest.approx(0.75)
    assert values(spark, [("A-b c",)], "a string", text.words(F.col("a"), "blanks"), text.words(F.col("a"), "characters"))[0] == (["a-b", "c"], ["a", "-", "b", "c"])


def test_bootstrap_pages_and_weights(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 2)) for i in range(3000)] + [(9000, "c", 1.0), (9001, "d", None)], "id int, g string, v double")
    got = {r["g"]: (r["stderr"], r["n"]) for r in aggregate.bootstrap_stderr(df, ["g"], "v", "id").collect()}
    assert got["a"] == (pytest.approx(0.5 / 2000**0.5, rel=0.3), 2000) and got["c"][0] == 0.0 and "d" not in got
    assert [r["id"] for r in sampling.page(df, ["id"], 3, 4).orderBy("place").collect()] == [8, 9, 10, 11] and sampling.page(df.limit(0), ["id"], 1, 5).count() == 0
    assert sum(w for *_, w in sampling.flat_weights({"parts": [{"name": "x", "weight": 2, "parts": [{"dataset": "d", "weight": 1}, {"dataset": "e", "weight": 3}]}, {"dataset": "f", "weight": 1}]})) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        sampling.page(df, ["id"], 0, 4)


def test_verdict(spark):
    t = ["YES", "I say no.", "It is true", "nothing", "yesterday no", None, ""]
    assert [g[0] for g in values(spark, [(x,) for x in t], "t string", scoring.verdict(F.col("t")))] == ["YES", "NO", "YES", None, "NO", None, None]


def test_release(spark):
    from tallyloom import session

    kept = session.durable(spark.range(3).toDF("id"), "r")
    assert kept.count() == 3 and session._written
    path = session._written[-1][1]
    session.release()
    import os

    assert not session._written and not os.path.exists(path)
