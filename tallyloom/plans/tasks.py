"""Queries of records, calls, pairings, pages and tables for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import extract, scoring, text
from tallyloom.operators import aggregate, nested, sampling
from tallyloom.plans.registry import Catalogue, table

catalogue = Catalogue()
_R = "(SELECT review_id, rec_id, task, lower(trim(model)) AS model, sample_index, input, target, sample_score.score.prediction AS p, sample_score.score.extracted_prediction AS e, sample_score.score.value[sample_score.score.main_score_name] AS v FROM reviews)"


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    return table(spark, folder, "reviews").select(
        "review_id", "rec_id", "task", F.lower(F.trim("model")).alias("model"), "sample_index", "input", "target", s.getField("prediction").alias("p"), s.getField("extracted_prediction").alias("e"), F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v")
    )


@catalogue.add("m81_fenced_code", rf"SELECT review_id, regexp_replace(coalesce(list_extract(regexp_extract_all(p, '(?s)```([\w+#-]*)[ \t]*\r?\n(.*?)```', 2), 1), CASE WHEN regexp_matches(p, '(?s)```[\w+#-]*[ \t]*\r?\n(.*)$') THEN regexp_extract(p, '(?s)```[\w+#-]*[ \t]*\r?\n(.*)$', 1) END), '\s+$', '') AS code FROM {_R}")
def m81(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", extract.fenced_code(F.col("p")).alias("code"))


@catalogue.add("m83_lenient_json", rf"SELECT review_id, md5(coalesce(CASE WHEN regexp_matches(a, '^\s*[\[{{]') AND json_valid(a) THEN a END, CASE WHEN regexp_matches(b, '^\s*[\[{{]') AND json_valid(b) THEN b END)) AS found FROM (SELECT review_id, trim(p, E' \t\n\r\v\f') AS a, nullif(regexp_extract(p, '(?s)(\{{.*\}})', 1), '') AS b FROM {_R})")
def m83(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", F.md5(extract.lenient_json(F.col("p"))).alias("found"))


@catalogue.add(
    "m44_letters_zh",
    rf"""SELECT review_id, CASE WHEN s <> '' THEN CASE WHEN regexp_matches(s, '^[ABCD,，]*$') THEN list_sort(list_distinct(string_split(regexp_replace(s, '[,，]', '', 'g'), ''))) ELSE [] END END AS letters
        FROM (SELECT review_id, regexp_extract('答案：' || coalesce(e, ''), '答案\s*[:：]\s*([A-Za-z0-9,，]+)', 1) AS s FROM {_R})""",
)
def m44(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", extract.chosen_letters_zh(F.concat(F.lit("答案："), F.coalesce("e", F.lit("")))).alias("letters"))


@catalogue.add(
    "m46_shuffled_choices",
    """WITH c AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w, p_size % 3 AS t FROM part), x AS (SELECT p_partkey, t, i - 1 AS i, w[i] AS x, md5(p_partkey || '-42-' || (i - 1)) AS r FROM (SELECT p_partkey, w, t, unnest(generate_series(1, len(w))) AS i FROM c)),
       o AS (SELECT p_partkey, x, i = t AS hit, row_number() OVER (PARTITION BY p_partkey ORDER BY r) - 1 AS place FROM x) SELECT p_partkey, string_agg(x, ' ' ORDER BY place) AS choices, CAST(max(place) FILTER (hit) AS INT) AS target FROM o GROUP BY ALL""",
)
def m46(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", extract.shuffled_choices(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.col("p_size") % 3, F.col("p_partkey")).alias("s"))
    return p.select("p_partkey", F.array_join("s.choices", " ").alias("choices"), F.col("s.target").alias("target"))


_CALLS = """SELECT rec_id, list_filter(flatten(list_transform(model_output.choices, lambda c: coalesce(c.message.tool_calls, []))), lambda t: t IS NOT NULL) AS calls FROM predictions"""


@catalogue.add(
    "m55_tool_calls",
    f"""WITH c AS (SELECT rec_id, unnest(calls) AS t, generate_subscripts(calls, 1) - 1 AS i FROM ({_CALLS})), f AS (SELECT rec_id, calls[1].function AS f FROM ({_CALLS}))
        SELECT c.rec_id, i AS call, CAST(coalesce(c.t.function = f.f, c.t.function IS NULL AND f.f IS NULL) AS DOUBLE) AS action_em, CAST(c.t.function IS NOT NULL AND c.t.function NOT IN ('search', 'lookup', 'calculator', 'python') AS DOUBLE) AS hallucinated FROM c JOIN f USING (rec_id)""",
)
def m55(spark: SparkSession, folder: str) -> DataFrame:
    """Every tool call against its record's first."""
    lists = F.transform("model_output.choices", lambda c: F.coalesce(c["message"]["tool_calls"], F.array().cast("array<struct<id:string,function:string,arguments:string>>")))
    calls = table(spark, folder, "predictions").select("rec_id", F.filter(F.flatten(lists), lambda t: t.isNotNull()).alias("calls"))
    call = lambda t: F.struct(F.lit("call").alias("plan"), t["function"].alias("action"), F.from_json(t["arguments"], "map<string,string>").alias("arguments"))
    each = calls.select("rec_id", F.get("calls", F.lit(0)).alias("first"), F.posexplode("calls").alias("call", "t"))
    tools = F.array(*map(F.lit, ("search", "lookup", "calculator", "python")))
    return each.select("rec_id", "call", extract.tool_call_scores(call(F.col("t")), call(F.col("first")), tools).alias("s")).select("rec_id", "call", "s.action_em", "s.hallucinated")


@catalogue.add("m65_keyword_overlap", f"SELECT review_id, coalesce(len(list_filter(k, lambda w: contains(lower(coalesce(p, '')), lower(w)))) / nullif(len(k), 0), 0) AS score FROM (SELECT review_id, p, list_filter(string_split(coalesce(target, ''), ' '), lambda w: w <> '') AS k FROM {_R})")
def m65(spark: SparkSession, folder: str) -> DataFrame:
    keys = F.filter(F.split(F.coalesce("target", F.lit("")), " "), lambda w: w != "")
    return _reviews(spark, folder).select("review_id", extract.keyword_overlap(F.col("p"), keys).alias("score"))


@catalogue.add("m42_best_reference", f"SELECT review_id, CAST(greatest(coalesce(lower(trim(e)) = lower(trim(target)), false), coalesce(lower(trim(e)) = lower(trim(p)), false)) AS DOUBLE) AS score FROM {_R}")
def m42(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", scoring.best_over(F.col("e"), F.array("target", "p"), lambda p, r: F.coalesce((F.lower(F.trim(p)) == F.lower(F.trim(r))).cast("double"), F.lit(0.0))).alias("score"))


@catalogue.add("m51_needle_cells", "SELECT 'length_' || (l_linenumber * 1000) || '_depth_' || CAST(round(l_discount * 100) AS BIGINT) AS metric, avg(CAST(l_returnflag = 'N' AS DOUBLE)) AS score, count(*) AS n FROM lineitem GROUP BY ALL")
def m51(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.concat(F.lit("length_"), (F.col("l_linenumber") * 1000).cast("bigint"), F.lit("_depth_"), F.round(F.col("l_discount") * 100).cast("bigint"))
    return table(spark, folder, "lineitem").groupBy(cell.alias("metric")).agg(F.avg((F.col("l_returnflag") == "N").cast("double")).alias("score"), F.count("*").alias("n"))


@catalogue.add(
    "m77_turns",
    """SELECT turn, count(*) AS n, avg(CAST(NOT contains(content, ',') AS DOUBLE)) AS no_comma, avg(CAST(content = lower(content) AS DOUBLE)) AS lowercase FROM (
        SELECT m.content AS content, row_number() OVER (PARTITION BY rec_id ORDER BY i) AS turn FROM (SELECT rec_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM predictions) WHERE m.role = 'assistant' AND m.content IS NOT NULL) GROUP BY ALL""",
)
def m77(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction checks by turn; the turns of a record are numbered within its row."""
    from tallyloom.functions import instructions

    said = F.filter(F.arrays_zip(F.col("messages.role").alias("role"), F.col("messages.content").alias("content")), lambda m: (m["role"] == "assistant") & m["content"].isNotNull())
    turns = table(spark, folder, "predictions").select(F.posexplode(said).alias("turn", "m")).select((F.col("turn") + 1).cast("bigint").alias("turn"), F.col("m.content").alias("c"))
    share = lambda check: F.avg(check.cast("double"))
    return turns.groupBy("turn").agg(F.count("*").alias("n"), share(instructions.without(F.col("c"), ",")).alias("no_comma"), share(F.col("c") == F.lower("c")).alias("lowercase"))


@catalogue.add(
    "j07_arena_pairs",
    f"""WITH l AS (SELECT task, model, sample_index, arg_max(v, review_id) AS v FROM {_R} WHERE model <> '' GROUP BY ALL), b AS (SELECT min(model) AS baseline FROM l)
        SELECT a.task, a.sample_index, a.model, b.baseline, a.v AS score, c.v AS baseline_score FROM l a, b JOIN l c ON c.model = b.baseline AND c.task = a.task AND c.sample_index = a.sample_index WHERE a.model <> b.baseline""",
)
def j07(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's latest score beside the baseline's on the same sample; samples that one of them lacks are left out."""
    latest = _reviews(spark, folder).filter("model <> ''").groupBy("task", "model", "sample_index").agg(F.max_by("v", "review_id").alias("v"))
    first = _reviews(spark, folder).filter("model <> ''").agg(F.min("model").alias("baseline"))  # one row
    marked = latest.crossJoin(F.broadcast(first))
    base = marked.filter("model = baseline").select("task", "sample_index", F.col("v").alias("baseline_score"))
    return marked.filter("model <> baseline").join(base, ["task", "sample_index"]).select("task", "sample_index", "model", "baseline", F.col("v").alias("score"), "baseline_score")


@catalogue.add("l13_page", "SELECT doc_id, source, r AS place FROM (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r BETWEEN 41 AND 60")
def l13(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.page(table(spark, folder, "documents").select("doc_id", "source", "n_chars"), ["n_chars", "doc_id"], 3, 20).select("doc_id", "source", "place")


@catalogue.add("l12_flat_weights", "SELECT * FROM (VALUES ('reasoning/math', 'gsm', 0.5), ('reasoning', 'arc', 0.25), ('chat', 'arena', 0.25)) AS t(path, dataset, weight)")
def l12(spark: SparkSession, folder: str) -> DataFrame:
    tree = {"weight": 1, "parts": [{"name": "reasoning", "weight": 3, "parts": [{"name": "math", "weight": 2, "parts": [{"dataset": "gsm", "weight": 5}]}, {"dataset": "arc", "weight": 1}]}, {"name": "chat", "weight": 1, "parts": [{"dataset": "arena", "weight": 1}]}]}
    return spark.createDataFrame(sampling.flat_weights(tree), "path string, dataset string, weight double")


@catalogue.add("a37_bootstrap_stderr")
def a37(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.bootstrap_stderr(_reviews(spark, folder).filter("v is not null"), ["task"], "v", "review_id")


@catalogue.add("r07_accuracy_table", "SELECT model_name, dataset_name, round(avg(score) * 100, 4) AS accuracy, count(*) AS n FROM reports WHERE score IS NOT NULL GROUP BY ALL")
def r07(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports").filter("score is not null").groupBy("model_name", "dataset_name").agg(F.round(F.avg("score") * 100, 4).alias("accuracy"), F.count("*").alias("n"))


@catalogue.add("r12_review_frame", f"SELECT review_id, sample_index AS index, md5(coalesce(input, '')) AS input, coalesce(e, p, '') AS pred, coalesce(target, '') AS gold, v AS score, CASE WHEN v >= 0.99 THEN 'Pass' WHEN v IS NOT NULL THEN 'Fail' END AS passed FROM {_R}")
def r12(spark: SparkSession, folder: str) -> DataFrame:
    passed = F.when(F.col("v") >= 0.99, "Pass").when(F.col("v").isNotNull(), "Fail")
    return _reviews(spark, folder).select("review_id", F.col("sample_index").alias("index"), F.md5(F.coalesce("input", F.lit(""))).alias("input"), F.coalesce("e", "p", F.lit("")).alias("pred"), F.coalesce("target", F.lit("")).alias("gold"), F.col("v").alias("score"), passed.alias("passed"))


@catalogue.add("proj04_targets", f"SELECT review_id, [coalesce(target, '')] AS targets FROM {_R}")
def proj04(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).select("review_id", extract.read_target(F.col("target")).alias("targets"))


@catalogue.add("proj16_leak_safe", "SELECT rec_id, task, sample_index, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.lang') AS lang FROM predictions")
def proj16(spark: SparkSession, folder: str) -> DataFrame:
    """Samples without what would give the answer away: only the named field of the metadata stays."""
    return table(spark, folder, "predictions").select("rec_id", "task", "sample_index", F.get_json_object("metadata", "$.lang").alias("lang"))


@catalogue.add(
    "proj17_message_text",
    """SELECT rec_id, i - 1 AS msg_pos, md5(CASE WHEN starts_with(c, '[') AND json_valid(c) AND len(list_filter(CAST(c AS JSON[]), lambda e: json_type(e) <> 'NULL' AND (json_type(e) <> 'OBJECT' OR NOT json_exists(e, '$.type')))) = 0
            THEN array_to_string(list_filter(list_transform(list_filter(CAST(c AS JSON[]), lambda e: e ->> '$.type' = 'text'), lambda e: e ->> '$.text'), lambda t: t IS NOT NULL), chr(10)) ELSE c END) AS text
       FROM (SELECT rec_id, i, messages[i].content AS c FROM (SELECT rec_id, messages, unnest(generate_series(1, len(messages))) AS i FROM predictions)) WHERE c <> ''""",
)
def proj17(spark: SparkSession, folder: str) -> DataFrame:
    parts = nested.content_parts(F.col("m"))
    texts = F.transform(F.filter(parts, lambda e: e.isNotNull() & (F.coalesce(e["type"], F.lit("text")) == "text") & e["text"].isNotNull()), lambda e: e["text"])
    m = table(spark, folder, "predictions").select("rec_id", F.posexplode("messages.content").alias("msg_pos", "m")).filter("m <> ''")
    return m.select("rec_id", F.col("msg_pos").cast("bigint").alias("msg_pos"), F.md5(F.array_join(texts, "\n")).alias("text"))


@catalogue.add("proj30_runs", "SELECT rec_id, run_dir FROM predictions WHERE run_dir = 'run_7' OR ends_with(run_dir, '/run_7') OR ends_with(run_dir, '/run_597')")
def proj30(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.of_runs(table(spark, folder, "predictions"), ["run_7", "run_597"]).select("rec_id", "run_dir")


@catalogue.add("u07_distinct_answers", f"SELECT task, sample_index, count(DISTINCT lower(trim(e))) AS n_answers FROM {_R} WHERE e IS NOT NULL GROUP BY ALL")
def u07(spark: SparkSession, folder: str) -> DataFrame:
    return _reviews(spark, folder).filter("e is not null").select("task", "sample_index", F.lower(F.trim("e")).alias("e")).distinct().groupBy("task", "sample_index").agg(F.count("*").alias("n_answers"))
