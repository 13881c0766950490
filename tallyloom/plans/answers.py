"""Queries that extract and compare answers (rest of inventory M), and aggregations over spans and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import answers, scoring
from tallyloom.operators import aggregate
from tallyloom.plans.registry import Catalogue, table
from tallyloom.plans.scores import VERDICT

catalogue = Catalogue()


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews").select("review_id", "task", "input", "target", F.col("sample_score.score.prediction").alias("p"), F.col("sample_score.score.extracted_prediction").alias("e"))


@catalogue.add("m30_extract_answer")
def m30(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", answers.extract_answer(F.col("p")).alias("answer"))


@catalogue.add("m31_math_equal")
def m31(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", answers.math_equal(F.col("p"), F.col("target")).alias("score"))


@catalogue.add("m35_plain_text")
def m35(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", answers.plain(F.col("p")).alias("plain"))


@catalogue.add("m37_corpus_bleu")
def m37(spark: SparkSession, folder: str) -> DataFrame:
    return answers.corpus_bleu(_reviews(spark, folder), F.col("p"), F.col("input"), ["task"])


@catalogue.add("m48_drop_f1")
def m48(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select(
        "review_id", answers.drop_f1(F.array(F.coalesce("e", F.lit(""))), F.array(F.coalesce("target", F.lit("")))).alias("f1")
    )


@catalogue.add(
    "m22_listed_answer",
    """SELECT review_id, coalesce(CAST(list_contains(list_transform(TRY_CAST(json_extract(j, '$.candidates') AS VARCHAR[]), lambda x: lower(x)), lower(j ->> '$.answer')) AS DOUBLE), 0.0) AS score
       FROM (SELECT review_id, CASE WHEN json_valid(p) AND p LIKE '{%' THEN p END AS j FROM (SELECT review_id, sample_score.score.prediction AS p FROM reviews))""",
)
def m22(spark: SparkSession, folder: str) -> DataFrame:
    r = _reviews(spark, folder)
    j = F.from_json(F.when(F.col("p").startswith("{") & F.try_parse_json("p").isNotNull(), F.col("p")), "answer string, candidates array<string>")
    return r.select("review_id", F.coalesce(F.array_contains(F.transform(j["candidates"], F.lower), F.lower(j["answer"])), F.lit(False)).cast("double").alias("score"))


@catalogue.add("m25_fluency")
def m25(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct embeddings in each group of a hundred rows: greedy, so a group is one list; a group is bounded by its key."""
    g = table(spark, folder, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("sample")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    return g.select("sample", answers.arrow(lambda v: len(answers.greedy_distinct([list(x) for x in v])), "int")(F.col("v")).alias("fluency"))


@catalogue.add("m68_near_duplicate")
def m68(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("e is not null and target is not null").select("review_id", answers.arrow(answers.near_duplicate, "boolean")(F.col("e"), F.col("target")).alias("same"))


@catalogue.add(
    "a10_multi_label_f1",
    """WITH x AS (SELECT p_partkey, list_distinct(string_split(p_type, ' ')) AS a, list_distinct(string_split(p_name, ' ')) AS p FROM part),
       l AS (SELECT unnest(list_distinct(list_concat(a, p))) AS label, a, p FROM x),
       c AS (SELECT label, count(*) FILTER (list_contains(a, label) AND list_contains(p, label)) AS tp, count(*) FILTER (list_contains(p, label)) AS np, count(*) FILTER (list_contains(a, label)) AS na FROM l GROUP BY ALL)
       SELECT label, tp, np, na, coalesce(2 * tp / nullif(np + na, 0), 0) AS f1 FROM c""",
)
def a10(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "part").select(F.array_distinct(F.split("p_type", " ")).alias("a"), F.array_distinct(F.split("p_name", " ")).alias("p"))
    label = x.select(F.explode(F.array_union("a", "p")).alias("label"), "a", "p")
    c = label.groupBy("label").agg(
        F.count_if(F.array_contains("a", F.col("label")) & F.array_contains("p", F.col("label"))).alias("tp"), F.count_if(F.array_contains("p", F.col("label"))).alias("np"), F.count_if(F.array_contains("a", F.col("label"))).alias("na")
    )
    return c.withColumn("f1", aggregate.ratio(2 * F.col("tp").cast("double"), F.col("np") + F.col("na")))


@catalogue.add(
    "a12_tool_calls",
    """WITH c AS (SELECT model_output.model AS model, len(list_filter(list_transform(model_output.choices, lambda c: c.message.tool_calls), lambda t: t IS NOT NULL AND len(t) > 0)) > 0 AS called,
        len(list_filter(messages, lambda m: m.role = 'tool')) > 0 AS wanted FROM predictions)
       SELECT model, count(*) FILTER (called AND wanted) AS tp, count(*) FILTER (called AND NOT wanted) AS fp, count(*) FILTER (NOT called AND wanted) AS fn, count(*) AS n FROM c WHERE called IS NOT NULL AND wanted IS NOT NULL GROUP BY ALL""",
)
def a12(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").select(
        F.col("model_output.model").alias("model"), F.exists("model_output.choices", lambda c: F.coalesce(F.size(c["message"]["tool_calls"]) > 0, F.lit(False))).alias("called"), F.exists(F.col("messages.role"), lambda r: r == "tool").alias("wanted")
    ).filter("called is not null and wanted is not null")
    called, wanted = F.col("called"), F.col("wanted")
    return p.groupBy("model").agg(F.count_if(called & wanted).alias("tp"), F.count_if(called & ~wanted).alias("fp"), F.count_if(~called & wanted).alias("fn"), F.count("*").alias("n"))


@catalogue.add("a14_map_pass_rate", "SELECT metric, count(*) FILTER (value >= 0.5) / count(*) AS rate, count(*) AS n FROM (SELECT unnest(map_keys(sample_score.score.value)) AS metric, unnest(map_values(sample_score.score.value)) AS value FROM reviews) GROUP BY ALL")
def a14(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "reviews").select(F.explode("sample_score.score.value").alias("metric", "value"))
    return m.groupBy("metric").agg((F.count_if(F.col("value") >= 0.5) / F.count("*")).alias("rate"), F.count("*").alias("n"))


@catalogue.add("a27_conditional_mean", "SELECT task, avg(v) FILTER (f >= 0.5) AS feasible_mean, count(*) FILTER (f >= 0.5) AS n FROM (SELECT task, sample_score.score.value[sample_score.score.main_score_name] AS v, list_min(map_values(sample_score.score.value)) AS f FROM reviews) GROUP BY ALL")
def a27(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    r = table(spark, folder, "reviews").select("task", F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v"), F.array_min(F.map_values(s.getField("value"))).alias("f"))
    ok = F.col("f") >= 0.5
    return r.groupBy("task").agg(F.avg(F.when(ok, F.col("v"))).alias("feasible_mean"), F.count_if(ok).alias("n"))


@catalogue.add(
    "a44_mean_of_runs",
    "SELECT run_dir, name, avg(v) AS mean FROM (SELECT run_dir, unnest(['input', 'output']) AS name, unnest([model_output.usage.input_tokens, model_output.usage.output_tokens]) AS v FROM predictions WHERE model_output.usage IS NOT NULL) GROUP BY ALL",
)
def a44(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("model_output.usage")
    p = table(spark, folder, "predictions").filter(u.isNotNull()).select("run_dir", u.getField("input_tokens").alias("input"), u.getField("output_tokens").alias("output"))
    return p.unpivot(["run_dir"], ["input", "output"], "name", "v").groupBy("run_dir", "name").agg(F.avg("v").alias("mean"))


@catalogue.add(
    "a55_correlation",
    "SELECT event_type, round(corr(value, user_id), 6) AS pearson FROM events GROUP BY ALL",
)
def a55(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 6).alias("pearson"))


@catalogue.add(
    "m71_judge_merge",
    f"""WITH j AS (SELECT sample_key, stage, judge_key, max({VERDICT}) AS v FROM audit_fulltask_caches WHERE {VERDICT} IS NOT NULL GROUP BY ALL)
       SELECT sample_key, stage, bool_and(v = 'YES') AS all_yes, avg(CASE WHEN v = 'YES' THEN 1.0 ELSE 0 END) AS share, count(*) AS n FROM j GROUP BY ALL""",
)
def m71(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "audit_fulltask_caches").select("sample_key", "stage", "judge_key", scoring.verdict(F.col("raw_judge_response")).alias("v")).filter("v is not null")
    j = v.groupBy("sample_key", "stage", "judge_key").agg(F.max("v").alias("v"))
    yes = F.col("v") == "YES"
    return j.groupBy("sample_key", "stage").agg(F.bool_and(yes).alias("all_yes"), F.avg(yes.cast("double")).alias("share"), F.count("*").alias("n"))


@catalogue.add("m74_judge_recall", "SELECT review_id, CASE WHEN em > 0.99 THEN em ELSE greatest(0.0, least(1.0, coalesce(TRY_CAST(target AS DOUBLE), 0))) END AS score FROM (SELECT review_id, target, coalesce(lower(trim(sample_score.score.extracted_prediction)) = lower(trim(target)), false)::DOUBLE AS em FROM reviews)")
def m74(spark: SparkSession, folder: str) -> DataFrame:
    rule = scoring.exact_match(F.col("e"), F.col("target"))
    judge = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("target").try_cast("double"), F.lit(0.0))))
    return _reviews(spark, folder).select("review_id", F.when(rule > 0.99, rule).otherwise(judge).alias("score"))


@catalogue.add("m24_semantic_distance", "WITH g AS (SELECT floor(vec_id / 10)::BIGINT AS sample, list(embedding::DOUBLE[] ORDER BY vec_id) AS v FROM embeddings GROUP BY ALL), p AS (SELECT sample, v[i] AS a, v[j] AS b FROM (SELECT sample, v, unnest(generate_series(1, len(v))) AS i FROM g), (SELECT unnest(generate_series(1, 10)) AS j) WHERE j > i AND j <= len(v)) SELECT sample, round(avg(CASE WHEN list_cosine_similarity(a, b) <= 0 THEN 100 ELSE 1 / list_cosine_similarity(a, b) END), 4) AS distance FROM p GROUP BY ALL")
def m24(spark: SparkSession, folder: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    g = table(spark, folder, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("sample")).agg(v.alias("v")).filter(F.size("v") > 1)
    far = lambda a, b: scoring.once(scoring.cosine(a, b), lambda c: F.when(c <= 0, 100.0).otherwise(1 / c))
    return g.select("sample", F.round(scoring.mean_pairwise(F.col("v"), far), 4).alias("distance"))


@catalogue.add("a06_entity_scores")
def a06(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators import spans

    words = F.split("p_name", " ")
    gold = F.transform(words, lambda w: F.when(w < "m", F.concat(F.lit("B-"), F.upper(F.substring(w, 1, 1)))).otherwise("O"))
    guess = F.transform(words, lambda w: F.when(w < "p", F.concat(F.lit("B-"), F.upper(F.substring(w, 1, 1)))).otherwise("O"))
    return spans.entity_scores(table(spark, folder, "part").select("p_brand", gold.alias("g"), guess.alias("p")), ["p_brand"], "g", "p")


@catalogue.add("m37_chrf")
def m37_chrf(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators import spans

    return spans.corpus_chrf(_reviews(spark, folder).select("task", "p", "input"), ["task"], "p", "input")


@catalogue.add("m28_originality")
def m28(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators import clustering

    e = table(spark, folder, "embeddings")
    return clustering.idea_scores(e.filter("vec_id % 5 = 0").withColumn("sample", F.floor(F.col("vec_id") / 50)), e.filter("vec_id % 5 <> 0"), "sample")


@catalogue.add(
    "a36_all_right_with_error",
    "WITH k AS (SELECT task, sample_index, CAST(bool_and(sample_score.score.value[sample_score.score.main_score_name] >= 0.5) AS DOUBLE) AS ok FROM reviews WHERE sample_score.score.value[sample_score.score.main_score_name] IS NOT NULL GROUP BY ALL) SELECT task, avg(ok) AS score, stddev_samp(ok) / sqrt(count(*)) AS stderr FROM k GROUP BY ALL",
)
def a36(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    r = table(spark, folder, "reviews").select("task", "sample_index", F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v")).filter("v is not null")
    k = r.groupBy("task", "sample_index").agg(F.bool_and(F.col("v") >= 0.5).cast("double").alias("ok"))
    return k.groupBy("task").agg(F.avg("ok").alias("score"), (F.stddev_samp("ok") / F.sqrt(F.count("*"))).alias("stderr"))


@catalogue.add(
    "a39_fractional_accuracy",
    """WITH p AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS preds FROM lineitem GROUP BY ALL)
       SELECT o_orderkey, CASE WHEN list_contains(preds, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END) THEN 1.0 / len(preds) ELSE 0.0 END AS score FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""",
)
def a39(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("preds"))  # three flags at most
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A").alias("a"))
    return o.join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.when(F.array_contains("preds", F.col("a")), 1.0 / F.size("preds")).otherwise(0.0).alias("score"))


@catalogue.add(
    "a53_average_precision",
    """WITH r AS (SELECT event_type, user_id % 3 = 0 AS rel, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events),
       s AS (SELECT *, sum(rel::INT) OVER (PARTITION BY event_type ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM r)
       SELECT event_type, sum(CASE WHEN rel THEN seen / rank ELSE 0 END) / nullif(sum(rel::INT), 0) AS ap FROM s GROUP BY ALL""",
)
def a53(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.prefix import running_sum

    e = table(spark, folder, "events").select("event_type", (-F.col("value")).alias("low"), "event_id", (F.col("user_id") % 3 == 0).cast("bigint").alias("rel"), F.lit(1).cast("bigint").alias("one"))
    # classes are few and large, so ranks and hits run over ranges
    ranked = running_sum(running_sum(e, ["event_type"], ["low", "event_id"], "one", "rank"), ["event_type"], ["low", "event_id"], "rel", "seen")
    return ranked.groupBy("event_type").agg(F.try_divide(F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)), F.sum("rel")).alias("ap"))


@catalogue.add("m57_process_check", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 5 = 0 THEN 'correct_acc' ELSE 'error_acc' END AS metric, CAST(l_linenumber % 4 = l_suppkey % 5 - 1 AS DOUBLE) AS score FROM lineitem")
def m57(spark: SparkSession, folder: str) -> DataFrame:
    reference = F.col("l_suppkey") % 5 - 1
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(reference == -1, "correct_acc").otherwise("error_acc").alias("metric"), (F.col("l_linenumber") % 4 == reference).cast("double").alias("score"))


@catalogue.add("m72_story_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 * l_discount AS quc, greatest(0, 1 - l_tax * 10) AS satisfied FROM lineitem")
def m72(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50 * F.col("l_discount")).alias("quc"), F.greatest(F.lit(0.0), 1 - F.col("l_tax") * 10).alias("satisfied"))


@catalogue.add("m75_pairwise", "SELECT review_id, CASE regexp_extract(p, '\\[\\[(A>>B|A>B|A=B|B>A|B>>A)\\]\\]', 1) WHEN 'A>>B' THEN 1.0 WHEN 'A>B' THEN 0.75 WHEN 'B>A' THEN 0.25 WHEN 'B>>A' THEN 0.0 ELSE 0.5 END AS score FROM (SELECT review_id, sample_score.score.prediction AS p FROM reviews)")
def m75(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.pairwise_score(F.col("p")).alias("score"))


@catalogue.add("m79_pass_hat_k", "WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY ALL) SELECT o_custkey, CASE WHEN c < 2 THEN 0.0 ELSE c * (c - 1) / (n * (n - 1)) END AS score FROM g WHERE n >= 2")
def m79(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("c")).filter("n >= 2")
    return g.select("o_custkey", scoring.pass_hat_k(F.col("n"), F.col("c"), F.lit(2)).alias("score"))
