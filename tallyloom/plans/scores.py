"""Projections, filters and per-sample metrics (inventory P and M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring, text
from tallyloom.plans.registry import Catalogue, table

catalogue = Catalogue()

_WORD = "lower(regexp_extract(raw_judge_response, '(?i)(?:^|[^a-z0-9_])(yes|no|true|false)(?:[^a-z0-9_]|$)', 1))"
#: The SQL of scoring.verdict().
VERDICT = f"CASE WHEN {_WORD} IN ('yes', 'true') THEN 'YES' WHEN {_WORD} IN ('no', 'false') THEN 'NO' END"

_PRED = "sample_score.score.prediction"


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews").select("review_id", "task", F.col("input").alias("input"), "target", F.col(_PRED).alias("p"), F.col("sample_score.score.extracted_prediction").alias("e"))


_R = f"(SELECT review_id, task, input, target, {_PRED} AS p, sample_score.score.extracted_prediction AS e FROM reviews)"


@catalogue.add("proj01_record_mapping", "SELECT rec_id, coalesce(metadata ->> '$.lang', 'default') AS subset, CAST(metadata ->> '$.level' AS BIGINT) AS level FROM predictions")
def proj01(spark: SparkSession, folder: str) -> DataFrame:
    f = F.from_json("metadata", "lang string, level bigint")
    return table(spark, folder, "predictions").select("rec_id", F.coalesce(f["lang"], F.lit("default")).alias("subset"), f["level"].alias("level"))


@catalogue.add("proj05_choices", "SELECT p_partkey, array_to_string(list_transform(CASE WHEN contains(p_type, ',') THEN string_split(p_type, ',') ELSE regexp_split_to_array(trim(p_type), '\\s+') END, lambda x: trim(x)), '|') AS choices FROM part")
def proj05(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.array_join(text.choices(F.col("p_type")), "|").alias("choices"))


@catalogue.add("proj09_date_range", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND ts <= TIMESTAMP '2024-06-30'")
def proj09(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    first = e.agg(F.min("ts").alias("t"))  # one row
    return e.crossJoin(F.broadcast(first)).filter((F.col("ts") >= F.col("t") + F.expr("INTERVAL 3 DAY")) & (F.col("ts") <= F.lit("2024-06-30").cast("timestamp"))).select("event_id")


@catalogue.add("proj13_prompt", "SELECT p_partkey, 'Which size has ' || p_name || '?' || chr(10) || 'A) ' || p_size || chr(10) || 'B) ' || (p_size + 1) || chr(10) || 'ANSWER: A' AS prompt FROM part")
def proj13(spark: SparkSession, folder: str) -> DataFrame:
    lines = text.choice_lines(F.array(F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.lit("Which size has "), "p_name", F.lit("?\n"), lines, F.lit("\nANSWER: A")).alias("prompt"))


@catalogue.add(
    "proj14_few_shot",
    f"""WITH s AS (SELECT task, string_agg(target, ' | ' ORDER BY review_id) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY review_id) AS r FROM {_R} WHERE target IS NOT NULL) WHERE r <= 3 GROUP BY ALL)
        SELECT review_id, md5(coalesce(shots, '') || coalesce(input, '')) AS prompt FROM {_R} LEFT JOIN s USING (task)""",
)
def proj14(spark: SparkSession, folder: str) -> DataFrame:
    r = _reviews(spark, folder)

    ranked = r.filter("target is not null").select("task", "review_id", "target").withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy("review_id"))).filter("r <= 3")
    shots = ranked.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "target"))), lambda x: x["target"]), " | ").alias("shots"))
    return r.join(shots, "task", "left").select("review_id", F.md5(F.concat(F.coalesce("shots", F.lit("")), F.coalesce("input", F.lit("")))).alias("prompt"))


@catalogue.add(
    "proj15_system_prompt",
    "SELECT rec_id, len(messages) + CASE WHEN len(list_filter(messages, lambda m: m.role = 'system')) = 0 THEN 1 ELSE 0 END AS n_messages FROM predictions WHERE messages IS NOT NULL",
)
def proj15(spark: SparkSession, folder: str) -> DataFrame:
    roles = F.col("messages.role")
    return table(spark, folder, "predictions").filter("messages is not null").select("rec_id", F.size(F.when(F.exists(roles, lambda r: r == "system"), roles).otherwise(F.array_prepend(roles, F.lit("system")))).alias("n_messages"))


@catalogue.add("proj18_markdown", "SELECT rec_id, md5(array_to_string(list_transform(messages, lambda m: '**' || upper(m.role[1]) || m.role[2:] || '**: ' || coalesce(m.content, '')), chr(10) || chr(10))) AS markdown FROM predictions WHERE messages IS NOT NULL")
def proj18(spark: SparkSession, folder: str) -> DataFrame:
    both = F.arrays_zip(F.col("messages.role").alias("role"), F.col("messages.content").alias("content"))
    line = lambda m: F.concat(F.lit("**"), F.upper(F.substring(m["role"], 1, 1)), F.substr(m["role"], F.lit(2)), F.lit("**: "), F.coalesce(m["content"], F.lit("")))
    return table(spark, folder, "predictions").filter("messages is not null").select("rec_id", F.md5(F.array_join(F.transform(both, line), "\n\n")).alias("markdown"))


@catalogue.add("proj19_reasoning", f"SELECT review_id, CASE WHEN regexp_matches(p, '(?s)<think>.*?</think>') THEN trim(regexp_extract(p, '(?s)<think>(.*?)</think>', 1), E' \\t\\n\\r') END AS reasoning, trim(regexp_replace(p, '(?s)<think>.*?</think>', '', 'g'), E' \\t\\n\\r') AS answer FROM {_R} WHERE p IS NOT NULL")
def proj19(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.reasoning(p).alias("reasoning"), text.without_reasoning(p).alias("answer"))


@catalogue.add("proj20_regex", f"SELECT review_id, coalesce(trim(list_extract(regexp_extract_all(p, '(\\d+)', 1), -1)), '[invalid]') AS last, coalesce(trim(list_extract(regexp_extract_all(p, '(\\d+)', 1), 1)), '[invalid]') AS first FROM {_R} WHERE p IS NOT NULL")
def proj20(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.regex(p, r"(\d+)", 1, -1).alias("last"), text.regex(p, r"(\d+)").alias("first"))


@catalogue.add("proj21_regex_pos", f"SELECT review_id, array_to_string(regexp_extract_all(p, '(?:^|[^A-Za-z])([A-Z][a-z]+)', 1), ' ') AS tags FROM {_R} WHERE p IS NOT NULL")
def proj21(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.regex_pos(F.col("p"), r"(?:^|[^A-Za-z])([A-Z][a-z]+)").alias("tags"))


@catalogue.add("proj23_remove_until", f"SELECT review_id, CASE WHEN instr(p, ': ') > 0 THEN substr(p, instr(p, ': ') + 2) ELSE p END AS rest, ltrim(p, E' \\t\\n\\r') AS left_trimmed FROM {_R} WHERE p IS NOT NULL")
def proj23(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.remove_until(p, ": ").alias("rest"), text.remove_whitespace(p).alias("left_trimmed"))


@catalogue.add(
    "proj27_majority",
    "SELECT l_orderkey, arg_max(l_returnflag, {'n': n, 'p': -p, 'f': l_returnflag}) AS winner FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) GROUP BY ALL",
)
def proj27(spark: SparkSession, folder: str) -> DataFrame:
    flags = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("p"))
    return flags.groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("n", -F.col("p"), "l_returnflag")).alias("winner"))


@catalogue.add("proj28_filter_chain", f"SELECT review_id, coalesce(trim(list_extract(regexp_extract_all(CASE WHEN instr(p, ' ') > 0 THEN substr(p, instr(p, ' ') + 1) ELSE p END, '([a-z]+)', 1), 1)), '[invalid]') AS word FROM {_R} WHERE p IS NOT NULL")
def proj28(spark: SparkSession, folder: str) -> DataFrame:
    steps = [("remove_until", {"delimiter": " "}), ("regex", {"pattern": "([a-z]+)"})]
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.chain(F.col("p"), steps).alias("word"))


@catalogue.add("proj29_passed", "SELECT review_id, sample_score.score.value[sample_score.score.main_score_name] >= 0.99 AS passed FROM reviews")
def proj29(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    return table(spark, folder, "reviews").select("review_id", (F.try_element_at(s.getField("value"), s.getField("main_score_name")) >= 0.99).alias("passed"))


@catalogue.add("proj31_score_as_number", "SELECT event_id, coalesce(TRY_CAST(props ->> '$.k' AS DOUBLE), 0) AS score FROM events")
def proj31(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0)).alias("score"))


_STRIP = "trim({}, E' \\t\\n\\r')"


@catalogue.add(
    "m01_exact_match",
    f"SELECT review_id, coalesce(lower({_STRIP.format('p')}) = lower({_STRIP.format('target')}), false)::DOUBLE AS em, coalesce(p <> '' AND contains(target, p), false)::DOUBLE AS included, coalesce(p = target, false)::DOUBLE AS same FROM {_R}",
)
def m01(spark: SparkSession, folder: str) -> DataFrame:
    p, t = F.col("p"), F.col("target")
    return _reviews(spark, folder).select("review_id", *[scoring.METRICS[m](p, t).alias(n) for m, n in (("exact_match", "em"), ("inclusion", "included"), ("numeric_match", "same"))])


@catalogue.add(
    "m07_multi_choice",
    """WITH x AS (SELECT p_partkey, list_distinct(list_filter(string_split(upper(p_brand), ''), lambda c: c <> '')) AS p, list_distinct(list_filter(string_split(upper(p_type), ''), lambda c: c <> '')) AS r FROM part)
       SELECT p_partkey, CASE WHEN len(p) = 0 OR len(r) = 0 OR len(list_filter(p, lambda c: NOT list_contains(r, c))) > 0 THEN 0.0 ELSE len(list_intersect(p, r)) / len(r) END AS score FROM x""",
)
def m07(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", scoring.multi_choice_acc(F.col("p_brand"), F.col("p_type")).alias("score"))


@catalogue.add(
    "m08_anls",
    """WITH x AS (SELECT p_partkey, p_name AS p, [p_type, p_brand || ' ' || p_type] AS refs FROM part),
       d AS (SELECT p_partkey, list_min(list_transform(refs, lambda r: levenshtein(lower(regexp_replace(trim(p), '\\s+', ' ', 'g')), lower(regexp_replace(trim(r), '\\s+', ' ', 'g'))) / greatest(length(p), length(r)))) AS d FROM x)
       SELECT p_partkey, CASE WHEN 1 - d < 0.2 THEN 0.0 ELSE 1 - d END AS score FROM d""",
)
def m08(spark: SparkSession, folder: str) -> DataFrame:
    refs = F.array("p_type", F.concat_ws(" ", "p_brand", "p_type"))
    return table(spark, folder, "part").select("p_partkey", scoring.anls(F.col("p_name"), refs, 0.2).alias("score"))


@catalogue.add("m12_cosine_to_first", "WITH f AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, f")
def m12(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"))  # one vector
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@catalogue.add("m21_parsed_answer", f"SELECT review_id, CASE WHEN regexp_matches(p, '(?is)<answer>.*?</answer>') THEN {_STRIP.format("regexp_extract(p, '(?is)<answer>(.*?)</answer>', 1)")} WHEN p LIKE '{{%' AND json_valid(p) AND p ->> '$.answer' IS NOT NULL THEN p ->> '$.answer' ELSE {_STRIP.format('p')} END AS answer FROM {_R} WHERE p IS NOT NULL")
def m21(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.tagged_answer(F.col("p")).alias("answer"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({}, '')), '([㐀-鿿])', ' \1 ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"


@catalogue.add("m26_elaboration", f"SELECT review_id, len(list_filter({_WORDS.format('p')}, lambda w: w NOT IN ('the', 'a', 'an', 'of', 'to', 'and', 'in', 'it', 'is'))) AS n_words FROM {_R}")
def m26(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", F.size(F.filter(text.words(F.col("p")), lambda w: ~w.isin("the", "a", "an", "of", "to", "and", "in", "it", "is"))).alias("n_words"))


@catalogue.add("m31_numeric_equal", "SELECT l_orderkey, l_linenumber, CAST(abs(l_discount * 100 - l_tax) <= 0.0001 * abs(l_tax) OR abs(l_discount * 100 - l_tax / 100) <= 0.0001 * abs(l_tax / 100) OR abs(l_discount * 100 - l_tax * 100) <= 0.0001 * abs(l_tax * 100) AS DOUBLE) AS score FROM lineitem")
def m31(spark: SparkSession, folder: str) -> DataFrame:
    p, r = (F.col("l_discount") * 100).cast("string"), F.col("l_tax").cast("string")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scoring.numeric_equal(p, r).alias("score"))


_BAG = "list_sum(list_transform(list_distinct(list_intersect({p}, {r})), lambda w: least(len(list_filter({p}, lambda x: x = w)), len(list_filter({r}, lambda x: x = w)))))"


@catalogue.add(
    "m38_rouge_1",
    f"""WITH x AS (SELECT review_id, {_WORDS.format("p")} AS a, {_WORDS.format("input")} AS b FROM {_R}), s AS (SELECT review_id, coalesce({_BAG.format(p="a", r="b")}, 0)::DOUBLE AS s, len(a) AS n, len(b) AS m FROM x)
        SELECT review_id, coalesce(s / nullif(n, 0), 0) AS precision, coalesce(s / nullif(m, 0), 0) AS recall, CASE WHEN s > 0 THEN 2 * s / (n + m) ELSE 0 END AS f1 FROM s""",
)
def m38(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.rouge_n(F.col("p"), F.col("input")).alias("r")).select("review_id", "r.*")


@catalogue.add(
    "m38_rouge_2_blanks",
    f"""WITH t AS (SELECT review_id, list_filter(regexp_split_to_array(lower(coalesce(p, '')), '\\s+'), lambda w: w <> '') AS p, list_filter(regexp_split_to_array(lower(coalesce(input, '')), '\\s+'), lambda w: w <> '') AS r FROM {_R}),
        x AS (SELECT review_id, list_transform(p[2:], lambda w, i: p[i] || ' ' || w) AS a, list_transform(r[2:], lambda w, i: r[i] || ' ' || w) AS b FROM t),
        c AS (SELECT review_id, g, count(*) FILTER (s = 'a') AS n, count(*) FILTER (s = 'b') AS m FROM (SELECT review_id, 'a' AS s, unnest(a) AS g FROM x UNION ALL SELECT review_id, 'b', unnest(b) FROM x) GROUP BY ALL),
        o AS (SELECT review_id, sum(least(n, m))::DOUBLE AS s, sum(n) AS n, sum(m) AS m FROM c GROUP BY ALL)
        SELECT review_id, CASE WHEN s > 0 THEN 2 * s / (n + m) ELSE 0 END AS f1 FROM x LEFT JOIN o USING (review_id)""",
)
def m38_2(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.rouge_n(F.col("p"), F.col("input"), 2, "blanks")["f1"].alias("f1"))


@catalogue.add("m40_rouge_l_sum")
def m40(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.rouge_l_sum(F.col("p"), F.col("input")).alias("f1"))


@catalogue.add(
    "m36_bleu_1",
    f"""WITH x AS (SELECT review_id, {_WORDS.format("p")} AS a, {_WORDS.format("input")} AS b FROM {_R}), s AS (SELECT review_id, coalesce({_BAG.format(p="a", r="b")}, 0)::DOUBLE AS s, len(a) AS n, len(b) AS m FROM x)
        SELECT review_id, coalesce(s / nullif(n, 0) * CASE WHEN n >= m THEN 1.0 ELSE exp(1 - m / n) END, 0) AS bleu FROM s""",
)
def m36(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.clipped_precision(F.col("p"), F.col("input")).alias("bleu"))


@catalogue.add("m38_rouge_l")
def m38_l(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.rouge_l(F.col("p"), F.col("input")).alias("f1"))


@catalogue.add("m09_word_error_rate")
def m09(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.word_error_rate(F.col("p"), F.col("target")).alias("wer"))


@catalogue.add("m53_sequence_ratio")
def m53(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.sequence_ratio(F.col("e"), F.col("target")).alias("ratio"))


@catalogue.add("m41_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def m41(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@catalogue.add(
    "m43_chosen_letter",
    f"""SELECT review_id, coalesce(nullif(upper(regexp_extract(p, '(?mi)^\\s*ANSWER\\s*:\\s*([A-D])(?:[^A-Za-z0-9]|$)', 1)), ''), nullif(upper(regexp_extract(p, '(?i)ANSWER\\s*:\\s*([A-D])(?:[^A-Za-z0-9]|$)', 1)), ''),
        list_extract(regexp_extract_all('  ' || regexp_replace(p, '[^A-Za-z]', '  ', 'g') || '  ', ' ([A-D]) ', 1), -1)) AS letter FROM {_R} WHERE p IS NOT NULL""",
)
def m43(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.chosen_letter(F.col("p")).alias("letter"))


@catalogue.add("m45_letters", "SELECT p_partkey, CASE WHEN p_size < 26 THEN chr(65 + p_size) ELSE CAST(p_size - 25 AS VARCHAR) END AS letter FROM part")
def m45(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.letter(F.col("p_size")).alias("letter"))


@catalogue.add("m49_relaxed", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN CAST(abs(l_discount - l_tax) / abs(l_tax) <= 0.05 AS DOUBLE) ELSE CAST(CAST(l_discount AS VARCHAR) = CAST(l_tax AS VARCHAR) AS DOUBLE) END AS score FROM lineitem")
def m49(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scoring.relaxed_accuracy(F.col("l_discount").cast("string"), F.col("l_tax").cast("string")).alias("score"))


@catalogue.add("m50_qa_normalised", r"""SELECT review_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(p), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM """ + _R + " WHERE p IS NOT NULL")
def m50(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", text.qa_normalised(F.col("p")).alias("q"))


@catalogue.add(
    "m52_eq_score",
    """WITH d AS (SELECT l_orderkey, l_linenumber, [abs(l_quantity % 10 - 3), abs(l_linenumber - 2), l_partkey % 9, l_suppkey % 4]::DOUBLE[] AS d FROM lineitem)
       SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, (10 - 0.7477 * list_sum(list_transform(d, lambda x: CASE WHEN x = 0 THEN 0.0 WHEN x <= 5 THEN 6.5 / (1 + exp(-1.2 * (x - 4))) ELSE x END))) / 10)) AS score FROM d""",
)
def m52(spark: SparkSession, folder: str) -> DataFrame:
    d = F.array(F.abs(F.col("l_quantity") % 10 - 3), F.abs(F.col("l_linenumber") - 2).cast("double"), (F.col("l_partkey") % 9).cast("double"), (F.col("l_suppkey") % 4).cast("double"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scoring.eq_score(d).alias("score"))


@catalogue.add("m54_rubric", "SELECT report_id, list_sum(list_transform(list_filter(metrics, lambda m: m IS NOT NULL), lambda m: CASE WHEN m.score > 0.5 THEN m.num ELSE 0 END))::DOUBLE / nullif(list_sum(list_transform(list_filter(metrics, lambda m: m.num > 0), lambda m: m.num)), 0) AS score FROM reports")
def m54(spark: SparkSession, folder: str) -> DataFrame:
    m = F.filter("metrics", lambda x: x.isNotNull())
    met, points = F.transform(m, lambda x: F.coalesce(x["score"] > 0.5, F.lit(False))), F.transform(m, lambda x: x["num"].cast("double"))
    return table(spark, folder, "reports").select("report_id", scoring.rubric_score(met, points).alias("score"))


@catalogue.add("m58_contained", f"SELECT review_id, coalesce(contains(regexp_replace(lower(p), '\\s', '', 'g'), regexp_replace(lower(target), '\\s', '', 'g')), false)::DOUBLE AS score FROM {_R}")
def m58(spark: SparkSession, folder: str) -> DataFrame:
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    return _reviews(spark, folder).select("review_id", F.coalesce(F.contains(squeeze(F.col("p")), squeeze(F.col("target"))), F.lit(False)).cast("double").alias("score"))


@catalogue.add(
    "m64_diversity",
    f"""WITH x AS (SELECT review_id, {_WORDS.format("p")} AS w FROM {_R}),
        g AS (SELECT review_id, list_transform([2, 3, 4], lambda n: CASE WHEN len(w) < n THEN [] ELSE list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' ')) END) AS g FROM x)
        SELECT review_id, list_reduce(list_transform(g, lambda n: coalesce((len(list_distinct(n)) / nullif(len(n), 0))::DOUBLE, 0)), lambda a, b: a * b) AS diversity FROM g""",
)
def m64(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.diversity(F.col("p")).alias("diversity"))


@catalogue.add("m66_techniques", f"SELECT review_id, array_to_string(list_filter([CASE WHEN regexp_matches(p, '\\bfor\\b.*:') THEN 'for loop' END, CASE WHEN p LIKE '%if %' THEN 'if statement' END, CASE WHEN p LIKE '%min(%' THEN 'minimum' END], lambda x: x IS NOT NULL), ',') AS techniques FROM {_R} WHERE p IS NOT NULL")
def m66(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    found = F.array_compact(F.array(F.when(F.regexp_like(p, F.lit(r"\bfor\b.*:")), "for loop"), F.when(F.contains(p, F.lit("if ")), "if statement"), F.when(F.contains(p, F.lit("min(")), "minimum")))
    return _reviews(spark, folder).filter("p is not null").select("review_id", F.array_join(found, ",").alias("techniques"))


@catalogue.add("m68_jaccard", f"WITH x AS (SELECT review_id, list_distinct({_WORDS.format('p')}) AS a, list_distinct({_WORDS.format('input')}) AS b FROM {_R}) SELECT review_id, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS jaccard FROM x")
def m68(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.jaccard(text.words(F.col("p")), text.words(F.col("input"))).alias("jaccard"))


@catalogue.add(
    "m70_gated_stages",
    f"""WITH v AS (SELECT sample_key, stage, {VERDICT} AS v FROM audit_fulltask_caches WHERE status = 'success' AND {VERDICT} IS NOT NULL),
       s AS (SELECT sample_key, bool_and(v = 'YES') FILTER (stage = 'correctness') AS correct, count(*) FILTER (stage = 'coarse_novelty' AND v = 'YES') * 2 > count(*) FILTER (stage = 'coarse_novelty') AS novel,
             count(*) FILTER (stage = 'fine_novelty' AND v = 'YES') * 2 > count(*) FILTER (stage = 'fine_novelty') AS fine FROM v GROUP BY ALL)
       SELECT sample_key, coalesce(correct, false) AS correct, coalesce(correct, false) AND novel AS novel, coalesce(correct, false) AND novel AND fine AS fine FROM s""",
)
def m70(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "audit_fulltask_caches").filter("status = 'success'").select("sample_key", "stage", scoring.verdict(F.col("raw_judge_response")).alias("v")).filter("v is not null")
    yes = F.col("v") == "YES"
    most = lambda stage: F.count_if((F.col("stage") == stage) & yes) * 2 > F.count_if(F.col("stage") == stage)
    s = v.groupBy("sample_key").agg(F.bool_and(F.when(F.col("stage") == "correctness", yes)).alias("c"), most("coarse_novelty").alias("n"), most("fine_novelty").alias("f"))
    c = F.coalesce("c", F.lit(False))
    return s.select("sample_key", c.alias("correct"), (c & F.col("n")).alias("novel"), (c & F.col("n") & F.col("f")).alias("fine"))


@catalogue.add("m73_judged_score", f"SELECT review_id, greatest(0.0, least(1.0, coalesce(CAST(list_extract(regexp_extract_all(p, '(-?\\d+(?:\\.\\d+)?)', 1), -1) AS DOUBLE), 0.0))) AS score FROM {_R}")
def m73(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", F.coalesce(scoring.judged_score(F.col("p")), F.lit(0.0)).alias("score"))


@catalogue.add(
    "m76_instructions",
    f"""SELECT review_id, len({_WORDS.format('p')}) >= 20 AS min_words, p = lower(p) AS lowercase, NOT contains(p, ',') AS no_comma, len(regexp_extract_all(p, '(?m)^\\s*[-*] ')) >= 3 AS bullets, json_valid(p) AND (p LIKE '{{%' OR p LIKE '[%') AS is_json,
        ends_with(trim(p, E' \\t\\n\\r'), '?') AS ends_question FROM {_R} WHERE p IS NOT NULL""",
)
def m76(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.functions import instructions

    p = F.col("p")
    checks = {"min_words": instructions.at_least_words(p, 20), "lowercase": instructions.lowercase(p), "no_comma": instructions.without(p, ","), "bullets": instructions.at_least_bullets(p, 3), "is_json": instructions.is_json(p), "ends_question": instructions.ends_with(p, "?")}
    return _reviews(spark, folder).filter("p is not null").select("review_id", *[c.alias(n) for n, c in checks.items()])


@catalogue.add(
    "m78_pass_at_k",
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS c FROM lineitem GROUP BY ALL)
       SELECT l_orderkey, CASE WHEN c <= 0 THEN 0.0 WHEN n - c < 2 THEN 1.0 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(generate_series(n - c + 1, n), lambda i: (1 - 2 / i)::DOUBLE)), lambda a, b: a * b) END AS pass_at_2 FROM g""",
)
def m78(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("c"))
    return g.select("l_orderkey", scoring.pass_at_k(F.col("n"), F.col("c"), F.lit(2)).alias("pass_at_2"))


@catalogue.add("m86_distinct_words", f"SELECT review_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT review_id, {_WORDS.format('p')} AS w, p FROM {_R}) WHERE p IS NOT NULL")
def m86(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("p is not null").select("review_id", F.array_join(F.array_distinct(text.words(F.col("p"))), " ").alias("words"))


@catalogue.add("m87_failure_modes", f"SELECT review_id, regexp_matches(p, '(?i)as an ai') AS disclaimer, regexp_matches(p, '(?i)sorry|cannot') AS apology, length(p) < 5 AS short FROM {_R} WHERE p IS NOT NULL")
def m87(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p")
    return _reviews(spark, folder).filter("p is not null").select("review_id", F.regexp_like(p, F.lit("(?i)as an ai")).alias("disclaimer"), F.regexp_like(p, F.lit("(?i)sorry|cannot")).alias("apology"), (F.char_length(p) < 5).alias("short"))
