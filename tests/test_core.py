"""Operators against results worked out by hand or by plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import instructions, scoring, text
from tallyloom.operators import aggregate, caches, nested, prefix, rating, retrieval, sampling
from tallyloom.sources import readers, writers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


def test_filters(spark):
    c = F.lit("the answer is 12, or 34 ")
    assert one(spark, text.regex(c, r"(\d+)")) == "12"
    assert one(spark, text.regex(c, r"(\d+)", 1, -1)) == "34"
    assert one(spark, text.regex(F.lit("none"), r"(\d+)")) == "[invalid]"
    assert one(spark, text.remove_until(F.lit("a::b::c"), "::")) == "b::c"
    assert one(spark, text.majority_vote(F.array(*map(F.lit, ["b", "a", "a", "b"])))) == "b"
    assert one(spark, text.chosen_letter(F.lit("I think\nANSWER: c"))) == "C"
    assert one(spark, text.chosen_letter(F.lit("maybe B"))) == "B"
    assert one(spark, text.qa_normalised(F.lit("The  Cat, a hat!"))) == "cat hat"
    with pytest.raises(ValueError, match="exists"):
        text.register_filter("regex")(lambda c: c)


def test_pass_estimators(spark):
    at = lambda n, c, k: one(spark, scoring.pass_at_k(F.lit(n), F.lit(c), F.lit(k)))
    assert at(4, 1, 2) == pytest.approx(0.5)
    assert at(5, 2, 3) == pytest.approx(0.9)
    assert (at(3, 0, 1), at(3, 3, 2)) == (0.0, 1.0)
    values = [at(10, 3, k) for k in range(1, 9)]
    assert values == sorted(values)
    assert one(spark, scoring.pass_hat_k(F.lit(4), F.lit(3), F.lit(2))) == pytest.approx(0.5)


def test_text_scores(spark):
    assert one(spark, scoring.rouge_l(F.lit("the cat sat"), F.lit("the cat ran"))) == pytest.approx(2 / 3)
    assert one(spark, scoring.rouge_n(F.lit("a b b"), F.lit("b b c")))["f1"] == pytest.approx(2 / 3)
    assert one(spark, scoring.word_error_rate(F.lit("a b c"), F.lit("a x c d"))) == pytest.approx(0.5)
    assert one(spark, scoring.numeric_equal(F.lit("50%"), F.lit("0.5"))) == 1.0
    assert one(spark, scoring.relaxed_accuracy(F.lit("104"), F.lit("100"))) == 1.0
    assert one(spark, scoring.relaxed_accuracy(F.lit("106"), F.lit("100"))) == 0.0
    assert one(spark, scoring.mean_pairwise(F.array(*map(F.lit, [1.0, 2.0, 4.0])), lambda a, b: F.abs(a - b))) == pytest.approx(2.0)
    assert one(spark, scoring.pairwise_score(F.lit("so [[B>>A]]"))) == 0.0
    assert one(spark, scoring.pairwise_score(F.lit("no verdict"), True)) == 0.5


def test_instructions(spark):
    c = F.lit("Intro line\n* a\n* b\n* c")
    assert one(spark, instructions.at_least_bullets(c, 3))
    assert not one(spark, instructions.lowercase(c))
    assert one(spark, instructions.loose(instructions.lowercase, c))
    assert one(spark, instructions.two_responses(F.lit("x ****** y")))


def test_aggregations(spark):
    rows = [("t", "m", g, i, str(i % 2), float(v)) for g, vs in ((1, (1, 0)), (2, (0, 0)), (3, (1, 1))) for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "task string, metric string, group_id int, review_id int, prediction string, value double")
    got = {r["metric"]: (r["score"], r["num"]) for r in aggregate.mean_and_pass_at_k(s, ["task"]).collect()}
    assert got["m"] == (0.5, 6) and got["m_pass@1"][0] == pytest.approx(0.5) and got["m_pass@2"][0] == pytest.approx(2 / 3)
    hat = {r["metric"]: r["score"] for r in aggregate.mean_and_pass_hat_k(s, ["task"]).collect()}
    assert hat["m_pass^2"] == pytest.approx(1 / 3)
    vote = {r["metric"]: r["score"] for r in aggregate.mean_and_vote_at_k(s, ["task"]).collect()}
    assert vote["m_vote@1"] == pytest.approx(2 / 3)
    assert aggregate.mean(s.limit(0), ["task"]).count() == 0
    c = aggregate.confusion(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, a boolean"), [], F.col("p"), F.col("a")).first()
    assert (c["f1"], c["accuracy"], c["mcc"]) == (0.5, 0.5, 0.0)


def test_running_sum_is_whole_under_a_hot_group(spark):
    random.seed(3)
    rows = [(None if random.random() < 0.1 else "hot" if random.random() < 0.7 else f"g{i % 5}", i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(r["g"], r["o"]): r["running"] for r in prefix.running_sum(df, ["g"], ["o"], "v").collect()}
    want, total = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        want[g, o] = total[g]
    assert got == want
    assert prefix.running_sum(df.limit(0), ["g"], ["o"], "v").count() == 0


def test_ratings(spark):
    g = spark.createDataFrame([("a", "b", "A>>B", False), ("a", "b", "B>A", True), ("b", "a", "A=B", False), ("a", "c", "B>A", False), ("c", "b", "A>B", False)], "model_a string, model_b string, verdict string, reversed boolean")
    fought = rating.battles(g)
    assert {(r["winner"], r["weight"]) for r in fought.collect()} == {("model_a", 3), ("model_a", 1), ("tie", 1), ("model_b", 1)}
    r = {x["model"]: x["rating"] for x in rating.bradley_terry(fought, "b").collect()}
    assert r["b"] == pytest.approx(1000) and r["c"] > r["a"] > r["b"]
    lone = spark.createDataFrame([("x", "y", "A>B", False)], "model_a string, model_b string, verdict string, reversed boolean")
    assert {x["model"]: x["rating"] for x in rating.bradley_terry(rating.battles(lone)).collect()} == {"x": 1400.0, "y": 1000.0}
    assert {x["model"]: x["win_rate"] for x in rating.win_rates(rating.bradley_terry(fought, "b"), "b").collect()}["b"] == 0.5


def test_search(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(99, None)], "vec_id bigint, embedding array<float>").repartition(3)
    q = e.filter("vec_id % 10 = 0")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.top_k(q, e, 2, block=2).collect()}
    assert got[10, 1] == 11 and got[0, 1] == 1 and len(got) == 6
    m = retrieval.ranking_metrics(retrieval.top_k(q, e, 2), spark.createDataFrame([(10, 11), (20, 0)], "query_id bigint, id bigint"), 2)
    assert {r["query_id"]: (r["ndcg"], r["recall"]) for r in m.collect()} == {10: (1.0, 1.0), 20: (0.0, 0.0)}


def test_caches(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 5, "z")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in caches.latest(a, ["k"], ["t"]).collect()} == {("k", "y"), (None, "z")}
    left = spark.createDataFrame([(1, "k", 2), (2, "k", 0), (3, None, 9)], "id int, k string, t int")
    assert {r["id"]: r["v"] for r in caches.as_of(left, a, ["k"], "t", "v", "id").collect()} == {1: "y", 2: None, 3: None}


def test_sampling(spark):
    s = spark.createDataFrame([("a", 50, 1), ("b", 30, 2), ("c", 20, 1)], "dataset string, n int, weight int")
    q = lambda how: {r["dataset"]: r["quota"] for r in sampling.quotas(s, 10, how).collect()}
    assert q("weighted") == {"a": 2, "b": 5, "c": 3} and q("uniform") == {"a": 3, "b": 3, "c": 3} and q("stratified") == {"a": 5, "b": 3, "c": 2}
    assert sampling.limited(s, ["n"], 0.5).count() == 1
    with pytest.raises(ValueError):
        sampling.limited(s, ["n"], -1)


def parts_of(c):
    if c is None or c == "":
        return []
    try:
        v = json.loads(c, parse_constant=lambda _: 1 / 0)
        if isinstance(v, list) and all(x is None or (isinstance(x, dict) and "type" in x) for x in v):
            return [i for i, x in enumerate(v) if x is not None]
    except (ValueError, ZeroDivisionError):
        pass
    return [0]


def test_content_parts(spark):
    texts = ['[{"type":"text"},null]', '[{"type":"text"}] x', '[{"type":"a"}] [1]', '[{"type":null}]', '[{"a":1}]', "[1,2]", "[]", " [ ] ", '[{"type":"a","type":"b"}]', '[{"type":"x","n":NaN}]', '["type"]', "[{'type':'x'}]", '[{"type":"text"},]',
             '[{"type":"x","n":01}]', "[null]", "", None, "abc", '[{"type":{"a":1}},null,{"type":3}]', '[{"type":"text"}],[{"type":"text"}]', "x" * 300_000, "[" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, c string")
    for r in df.select("c", nested.content_parts("c").alias("p")).collect():
        assert [i for i, e in enumerate(r["p"]) if e is not None] == parts_of(r["c"]), r["c"][:60]


def test_part_fields(spark):
    rows = [(1, [("user", "plain words"), None, ("assistant", '[{"type":"text","text":"hi","refusal":false},null,{"type":"data","data":{"k":8,"tags":["x",null]},"signature":null}]')]), (2, [("user", '["a", "b"]'), ("user", '[{"type":"x","n":1,"Text":"T"}, {"type":"y","n":"s","data":{"k":9}}]')]), (3, [("user", "")]), (4, None)]
    df = spark.createDataFrame(rows, "rec_id bigint, messages array<struct<role:string,content:string>>").withColumn("model_output", F.expr("named_struct('usage', named_struct('input_tokens', 1L))"))
    t = nested.prediction_tables(df)
    got = {(r["parent_id"], r["path"]): {k: v for k, v in r.asDict().items() if v is not None and k not in ("parent_id", "path", "ordinals", "row_key", "parent_key")} for r in t["predictions.messages.content"].collect()}
    assert got == {
        (1, "messages[0].content[0]"): {"text": "plain words"}, (1, "messages[2].content[0]"): {"type": "text", "text": "hi", "refusal": False}, (1, "messages[2].content[2]"): {"type": "data", "data_k": 8},
        (2, "messages[0].content[0]"): {"text": '["a", "b"]'}, (2, "messages[1].content[0]"): {"type": "x", "n": "1", "Text_": "T"}, (2, "messages[1].content[1]"): {"type": "y", "n": "s", "data_k": 9},
    }
    assert "signature" in t["predictions.messages.content"].columns
    assert [(r["path"], r["value"]) for r in t["predictions.messages.content.data.tags"].collect()] == [("messages[2].content[2].data.tags[0]", "x")]


def test_nested_tables(spark):
    rows = [(1, "n", [{"a": 1, "b": [{"c": 5}, None, {"c": 6}]}, None, {"a": 2, "b": []}]), (2, "n", []), (3, None, None), (1, "n", [{"a": 1, "b": None}])]
    df = spark.createDataFrame(rows, "path int, name string, xs array<struct<a:int,b:array<struct<c:int>>>>")
    t = nested.relational(df, "path", "r")
    assert [(r["parent_id"], r["path_"]) for r in t["r"].select("parent_id", "path_").collect()] == [(1, 1), (2, 2), (3, 3), (1, 1)]
    assert sorted((r["parent_id"], r["path"], r["a"]) for r in t["r.xs"].collect()) == [(1, "xs[0]", 1), (1, "xs[0]", 1), (1, "xs[2]", 2)]
    assert [(r["path"], r["ordinals"], r["c"]) for r in t["r.xs.b"].collect()] == [("xs[0].b[0]", [0, 0], 5), ("xs[0].b[2]", [0, 2], 6)]
    assert all(x.count() == 0 for x in nested.relational(df.limit(0), "path", "r").values())
    j = spark.createDataFrame([(1, '{"a": 1, "b": [{"x": "s"}]}'), (2, '{"a": 2.5}'), (3, "broken"), (4, None)], "id int, j string")
    assert {r["parent_id"]: r["fields_a"] for r in nested.json_tables(j, "id", "j")["json"].collect()} == {1: 1.0, 2: 2.5, 3: None, 4: None}


def test_sessions_over_many_files(spark, tmp_path):
    import datetime
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tallyloom.plans.streams import t06_sessions

    (tmp_path / "events.parquet").mkdir()
    for i in range(203):  # three batches of files; the last file is later than the watermark
        p = tmp_path / "events.parquet" / f"part-{i:05d}.parquet"
        ts = datetime.datetime(2024, 5, 1) + datetime.timedelta(days=0 if i == 202 else 60, minutes=i)
        pq.write_table(pa.table({"user_id": pa.array([i % 2], pa.int64()), "ts": pa.array([ts], pa.timestamp("us"))}), p)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    got = sorted((r["user_id"], str(r["start"]), r["n"]) for r in t06_sessions(spark, str(tmp_path)).collect())
    assert got == [(0, "2024-05-01 03:22:00", 1), (0, "2024-06-30 00:00:00", 101), (1, "2024-06-30 00:01:00", 101)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x", "n": 1}\nbroken\n{"q": "y"}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "q string, n int").count() == 2
    kept = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "q string, n int", keep_corrupt=True)
    assert {r["_corrupt"] for r in kept.collect()} == {None, "broken"}
    (tmp_path / "b.csv").write_text('q,a\n"x, ""y""",1\n')
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first().asDict() == {"q": 'x, "y"', "a": "1"}
    (tmp_path / "s_val.tsv").write_text("q\ta\nx\t1\n")
    assert readers.read_subset(spark, str(tmp_path), "s", "val").first()["a"] == "1"
    (tmp_path / "c.json").write_text('{"data": [{"q": "x"}, {"q": "y"}]}')
    assert readers.read_json_array(spark, str(tmp_path / "c.json"), "data").count() == 2
    (tmp_path / "d.txt").write_text('{"a": 1}{"a": 2}\\n{"a": 3}\n\n{"a": 4} {"a":\n')
    assert sorted(r["a"] for r in readers.read_concatenated_json(spark, str(tmp_path / "d.txt"), "a int").collect()) == [1, 2, 3, 4]
    (tmp_path / "e.txt").write_text('{\n  "a": 5,\n  "b": "x} {y"\n}\n{"a": 6}{bad{"a": 7}')
    assert sorted((r["a"], r["b"]) for r in readers.read_concatenated_json(spark, str(tmp_path / "e.txt"), "a int, b string").na.fill("").collect()) == [(5, "x} {y"), (6, ""), (7, "")]
    run = tmp_path / "run7" / "reports" / "m"
    run.mkdir(parents=True)
    (run / "x.json").write_text('{"model_name": "m", "dataset_name": "d", "score": 0.5}')
    (run / "y.json").write_text('{"other": 1}')
    assert [(r["run_dir"], r["score"]) for r in readers.read_reports(spark, str(tmp_path / "run7")).collect()] == [("run7", 0.5)]
    rows = spark.createDataFrame([("m", "d", "acc", "c", "s1", 1.0, 1), ("m", "d", "acc", "c", "s2", 0.0, 3)], "model string, dataset string, metric string, category string, subset string, score double, num int")
    assert json.loads(writers.report_trees(rows).first()["report"])["metrics"][0]["score"] == 0.25
    writers.write_csv(rows.select("model", F.array("num").alias("n")), str(tmp_path / "out"))
    assert sorted(r["n"] for r in readers.read_csv(spark, str(tmp_path / "out")).collect()) == ["[1]", "[3]"]
    writers.append_cache(rows, str(tmp_path / "cache"), ["dataset"])
    writers.append_cache(rows, str(tmp_path / "cache"), ["dataset"])
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 4
    assert [tuple(r) for r in writers.score_matrix(rows, "model", "subset", "score", ["s1", "s9"]).collect()] == [("m", "1.0", "")]
    assert readers.random_prompts(spark, 3, 4, ["a", "b"]).count() == 3


def test_native_metrics_stay_in_the_jvm(spark):
    df = spark.range(3).select(F.lit("a").alias("p"), F.lit("b").alias("r"))
    plan = df.select(scoring.exact_match(F.col("p"), F.col("r")), scoring.rouge_n(F.col("p"), F.col("r")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_rest_needs_no_llm():
    import pathlib

    for p in pathlib.Path(__file__).parent.parent.joinpath("tallyloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallyloom.llm" not in p.read_text(), p


def test_keys_and_maps_of_nested_records(spark):
    df = spark.createDataFrame([(1, [{"name": "m", "score": {"b": 2.0, "a": 1.0}}], "x"), (2, None, None)], "id int, items array<struct<name:string,score:map<string,double>>>, row_key string")
    t = nested.relational(df, "id", "r")
    assert set(t) == {"r", "r.items", "r.items.score"}
    assert {(r["row_key"], r["parent_key"], r["row_key_"]) for r in t["r"].collect()} == {("1:", None, "x"), ("2:", None, None)}
    assert [(r["row_key"], r["parent_key"], r["name"]) for r in t["r.items"].collect()] == [("1:items[0]", "1:", "m")]
    assert [(r["parent_key"], r["path"], r["key"], r["value"]) for r in t["r.items.score"].orderBy("path").collect()] == [("1:items[0]", "items[0].score[0]", "a", 1.0), ("1:items[0]", "items[0].score[1]", "b", 2.0)]
