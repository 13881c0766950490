"""Aggregations over reviews, reports and judge answers (inventory A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import aggregate, rating
from tallyloom.plans.registry import Catalogue, table

catalogue = Catalogue()

_R4 = "round(CAST(round({}, 9) AS DECIMAL(18, 9)), 4)::DOUBLE"

TIDY_SQL = """
    SELECT review_id, rec_id, task, lower(trim(model)) AS model, sample_index, sample_score.group_id AS group_id, sample_score.score.extracted_prediction AS prediction,
        unnest(map_keys(sample_score.score.value)) AS metric, unnest(map_values(sample_score.score.value)) AS value FROM reviews
"""
BINARY_SQL = f"SELECT * EXCLUDE (value), CAST(value >= 0.5 AS DOUBLE) AS value FROM ({TIDY_SQL})"


def tidy(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.tidy(table(spark, folder, "reviews"))


def binary(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(spark, folder).withColumn("value", (F.col("value") >= 0.5).cast("double"))


@catalogue.add("a01_mean_by_task", f"SELECT task, model, metric, coalesce(avg(value), 0) AS score, count(value) AS num FROM ({TIDY_SQL}) GROUP BY ALL")
def a01(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.mean(tidy(spark, folder), ["task", "model"])


@catalogue.add("a02_clipped_mean", f"SELECT task, metric, greatest(0.0, least(1.0, coalesce(avg(3 * value - 1), 0))) AS score, count(value) AS num FROM ({TIDY_SQL}) GROUP BY ALL")
def a02(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.clipped_mean(tidy(spark, folder).withColumn("value", 3 * F.col("value") - 1), ["task"])


_GROUPS_SQL = f"""
    SELECT *, greatest(1, floor(total / groups))::BIGINT AS k FROM (
        SELECT *, sum(n) OVER (PARTITION BY task, metric) AS total, count(*) OVER (PARTITION BY task, metric) AS groups, min(n) OVER (PARTITION BY task, metric) AS least_n
        FROM (SELECT task, metric, group_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS c FROM ({BINARY_SQL}) GROUP BY ALL))
"""
_MEAN_SQL = f"SELECT task, metric, coalesce(avg(value), 0) AS score, count(value) AS num FROM ({BINARY_SQL}) GROUP BY ALL"


@catalogue.add(
    "a03_pass_at_k",
    f"""
    {_MEAN_SQL} UNION ALL
    SELECT task, metric || '_pass@' || j, sum(p * n) / sum(n), CAST(sum(n) AS BIGINT) FROM (
        SELECT *, CASE WHEN c <= 0 THEN 0.0 WHEN n - c < j THEN 1.0 ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(generate_series(n - c + 1, n), lambda i: (1 - j / i)::DOUBLE)), lambda a, b: a * b) END AS p
        FROM (SELECT *, unnest(generate_series(1, k)) AS j FROM ({_GROUPS_SQL}))) GROUP BY ALL
    """,
)
def a03(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.mean_and_pass_at_k(binary(spark, folder), ["task"])


@catalogue.add(
    "a04_vote_at_k",
    f"""
    WITH b AS ({BINARY_SQL}), g AS ({_GROUPS_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY task, metric, group_id ORDER BY review_id) AS r FROM b),
    f AS (SELECT r.task, r.metric, r.group_id, prediction, value, r, k FROM r JOIN g ON r.task = g.task AND r.metric = g.metric AND r.group_id IS NOT DISTINCT FROM g.group_id WHERE r <= k),
    e AS (SELECT *, unnest(generate_series(r, k)) AS j FROM f),
    v AS (SELECT task, metric, group_id, j, prediction, count(*) AS n, min(r) AS pos, max(CASE WHEN value = 1.0 THEN 1.0 ELSE 0.0 END) AS ok FROM e GROUP BY ALL),
    w AS (SELECT task, metric, group_id, j, arg_max(ok, {{'n': n, 'p': -pos}}) AS v FROM v GROUP BY ALL)
    {_MEAN_SQL} UNION ALL
    SELECT w.task, w.metric || '_vote@' || j, sum(v * n) / sum(n), CAST(sum(n) AS BIGINT) FROM w JOIN g ON w.task = g.task AND w.metric = g.metric AND w.group_id IS NOT DISTINCT FROM g.group_id GROUP BY w.task, w.metric, j
    """,
)
def a04(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.mean_and_vote_at_k(binary(spark, folder), ["task"])


@catalogue.add(
    "a05_pass_hat_k",
    f"""
    {_MEAN_SQL} UNION ALL
    SELECT task, metric || '_pass^' || k, sum(p * n) / sum(n), CAST(sum(n) AS BIGINT) FROM (
        SELECT *, CASE WHEN c < k THEN 0.0 ELSE list_reduce(list_prepend(1.0::DOUBLE, list_transform(generate_series(0, k - 1), lambda i: ((c - i) / (n - i))::DOUBLE)), lambda a, b: a * b) END AS p
        FROM (SELECT * REPLACE (greatest(1, least(k, least_n)) AS k) FROM ({_GROUPS_SQL}))) GROUP BY ALL
    """,
)
def a05(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.mean_and_pass_hat_k(binary(spark, folder), ["task"])


@catalogue.add("a07_all_right", f"SELECT task, avg(ok) AS score, count(*) AS num FROM (SELECT task, rec_id, CAST(bool_and(value >= 0.5) AS DOUBLE) AS ok FROM ({TIDY_SQL}) GROUP BY ALL) GROUP BY ALL")
def a07(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.all_right(tidy(spark, folder), ["task"], ["rec_id"], F.col("value") >= 0.5)


@catalogue.add(
    "a08_confusion",
    """
    WITH c AS (SELECT event_type, count(*) FILTER (value >= 50 AND user_id % 2 = 0) AS tp, count(*) FILTER (value >= 50 AND user_id % 2 <> 0) AS fp, count(*) FILTER (value < 50 AND user_id % 2 = 0) AS fn,
        count(*) FILTER (value < 50 AND user_id % 2 <> 0) AS tn FROM events GROUP BY ALL),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
    SELECT event_type, tp, fp, fn, tn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
        coalesce((tp + fp) / nullif(tp + fp + fn + tn, 0), 0) AS yes_ratio,
        coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM r
    """,
)
def a08(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.confusion(table(spark, folder, "events"), ["event_type"], F.col("value") >= 50, F.col("user_id") % 2 == 0)


@catalogue.add(
    "a09_class_scores",
    """
    WITH p AS (SELECT l_returnflag AS p, CASE WHEN l_quantity > 25 THEN 'R' WHEN l_quantity > 10 THEN 'A' ELSE 'N' END AS a, count(*) AS n FROM lineitem GROUP BY ALL),
    l AS (SELECT label, sum(tp) AS tp, sum(np) AS n_p, sum(na) AS n_a FROM (SELECT p AS label, 0 AS tp, n AS np, 0 AS na FROM p UNION ALL SELECT a, CASE WHEN p = a THEN n ELSE 0 END, 0, n FROM p) GROUP BY ALL),
    f AS (SELECT *, coalesce(2 * tp / nullif(n_p + n_a, 0), 0) AS f1 FROM l)
    SELECT 'all' AS scope, sum(tp) / sum(n_a) AS accuracy, avg(f1) AS macro_f1, sum(f1 * n_a) / sum(n_a) AS weighted_f1, 2 * sum(tp) / (sum(n_p) + sum(n_a)) AS micro_f1, CAST(sum(n_a) AS BIGINT) AS n FROM f
    """,
)
def a09(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, folder, "lineitem").select(F.lit("all").alias("scope"), "l_returnflag", F.when(q > 25, "R").when(q > 10, "A").otherwise("N").alias("actual"))
    return aggregate.class_scores(rows, ["scope"], "l_returnflag", "actual")


@catalogue.add(
    "a11_conditional_accuracy",
    f"""SELECT task, coalesce(err, 0) AS err, coalesce(ok, 0) AS ok, CASE WHEN err + ok > 0 THEN 2 * err * ok / (err + ok) ELSE 0 END AS f1 FROM (
        SELECT task, avg(value) FILTER (sample_index % 2 = 0) AS err, avg(value) FILTER (sample_index % 2 = 1) AS ok FROM ({TIDY_SQL}) GROUP BY ALL)""",
)
def a11(spark: SparkSession, folder: str) -> DataFrame:
    side = lambda i: F.avg(F.when(F.col("sample_index") % 2 == i, F.col("value")))
    g = tidy(spark, folder).groupBy("task").agg(side(0).alias("err"), side(1).alias("ok"))
    return g.select("task", F.coalesce("err", F.lit(0.0)).alias("err"), F.coalesce("ok", F.lit(0.0)).alias("ok"), aggregate.ratio(2 * F.col("err") * F.col("ok"), F.col("err") + F.col("ok")).alias("f1"))


@catalogue.add("a13_ratio_of_sums", "SELECT model_output.model AS model, sum(model_output.usage.output_tokens) / nullif(sum(model_output.usage.total_tokens), 0) AS share, count(model_output.usage.total_tokens) AS num FROM predictions GROUP BY ALL")
def a13(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("model_output.usage")
    return table(spark, folder, "predictions").groupBy(F.col("model_output.model").alias("model")).agg(
        F.try_divide(F.sum(u.getField("output_tokens")).cast("double"), F.sum(u.getField("total_tokens"))).alias("share"), F.count(u.getField("total_tokens")).alias("num")
    )


@catalogue.add(
    "a15_binned_mean",
    """
    WITH b AS (SELECT CASE WHEN n_chars <= 128 THEN 0 WHEN n_chars <= 512 THEN 1 WHEN n_chars <= 2048 THEN 2 ELSE 3 END AS bin, n_chars FROM documents)
    SELECT coalesce(CAST(bin AS VARCHAR), 'overall') AS bin, avg(n_chars) AS mean_chars, count(*) AS num FROM b GROUP BY ROLLUP (bin)
    """,
)
def a15(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars")
    b = table(spark, folder, "documents").select(F.when(n <= 128, 0).when(n <= 512, 1).when(n <= 2048, 2).otherwise(3).alias("bin"), "n_chars")
    return b.rollup("bin").agg(F.avg("n_chars").alias("mean_chars"), F.count("*").alias("num")).withColumn("bin", F.coalesce(F.col("bin").cast("string"), F.lit("overall")))


@catalogue.add("a16_mean_by_name_part", f"SELECT regexp_extract(metric, '^[a-z]+', 0) AS part, avg(value) AS score, count(*) AS num FROM ({TIDY_SQL}) GROUP BY ALL")
def a16(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(spark, folder).groupBy(F.regexp_extract("metric", "^[a-z]+", 0).alias("part")).agg(F.avg("value").alias("score"), F.count("*").alias("num"))


def _part_games(spark: SparkSession, folder: str) -> DataFrame:
    """Battles between brands' parts of the same size, one game for each pair of neighbours by key."""
    p = table(spark, folder, "part")
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    g = p.withColumns({"other": F.lead("p_brand").over(w), "price": F.lead("p_retailprice").over(w)}).filter("other is not null and other <> p_brand")
    d = F.col("p_retailprice") - F.col("price")
    verdict = F.when(d > 50, "A>>B").when(d > 0, "A>B").when(d < -50, "B>>A").when(d < 0, "B>A").otherwise("A=B")
    return g.select(F.col("p_brand").alias("model_a"), F.col("other").alias("model_b"), verdict.alias("verdict"), (F.col("p_partkey") % 2 == 1).alias("reversed"))


@catalogue.add(
    "a17_battles",
    """
    WITH g AS (SELECT p_brand AS model_a, lead(p_brand) OVER w AS model_b, p_retailprice - lead(p_retailprice) OVER w AS d, p_partkey % 2 = 1 AS r FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)),
    v AS (SELECT model_a, model_b, r, CASE WHEN d > 50 THEN 3 WHEN d > 0 THEN 1 WHEN d < -50 THEN -3 WHEN d < 0 THEN -1 ELSE 0 END AS s FROM g WHERE model_b IS NOT NULL AND model_b <> model_a)
    SELECT model_a, model_b, CASE WHEN s = 0 THEN 'tie' WHEN (s > 0) <> r THEN 'model_a' ELSE 'model_b' END AS winner, CAST(sum(greatest(1, abs(s))) AS BIGINT) AS games FROM v GROUP BY ALL
    """,
)
def a17(spark: SparkSession, folder: str) -> DataFrame:
    return rating.battles(_part_games(spark, folder)).groupBy("model_a", "model_b", "winner").agg(F.sum("weight").alias("games"))


@catalogue.add("a18_bradley_terry")
def a18(spark: SparkSession, folder: str) -> DataFrame:
    return rating.bradley_terry(rating.battles(_part_games(spark, folder)), "Brand#11")


@catalogue.add("a19_win_rates")
def a19(spark: SparkSession, folder: str) -> DataFrame:
    return rating.win_rates(rating.bradley_terry(rating.battles(_part_games(spark, folder)), "Brand#11"), "Brand#11")


@catalogue.add("a20_bootstrap")
def a20(spark: SparkSession, folder: str) -> DataFrame:
    return rating.bootstrap_ratings(rating.battles(_part_games(spark, folder)), 100, "Brand#11")


@catalogue.add(
    "a21_two_stage_mean",
    """SELECT source, avg(m) AS mean_of_tasks, sum(s) / sum(n) AS weighted FROM (SELECT coalesce(source, 'none') AS source, task, avg(length(text)) AS m, sum(length(text) * n_chars) AS s, sum(n_chars) AS n FROM documents WHERE text IS NOT NULL AND n_chars > 0 GROUP BY ALL) GROUP BY source""",
)
def a21(spark: SparkSession, folder: str) -> DataFrame:
    n = F.char_length("text")
    per = table(spark, folder, "documents").filter("text is not null and n_chars > 0").groupBy(F.coalesce("source", F.lit("none")).alias("source"), "task").agg(F.avg(n).alias("m"), F.sum(n * F.col("n_chars")).alias("s"), F.sum("n_chars").alias("n"))
    return per.groupBy("source").agg(F.avg("m").alias("mean_of_tasks"), (F.sum("s") / F.sum("n")).alias("weighted"))


@catalogue.add(
    "a22_top_share_mean",
    f"""SELECT task, metric, avg(value) AS score, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY task, metric ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY task, metric) AS c FROM ({TIDY_SQL}) WHERE value IS NOT NULL)
        WHERE r <= greatest(1, ceil(c * 0.1)) GROUP BY ALL""",
)
def a22(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.top_share_mean(tidy(spark, folder), ["task", "metric"], "value")


@catalogue.add(
    "a23_level_delta",
    """WITH s AS (SELECT l_returnflag AS story, l_linenumber AS level, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
       SELECT story, avg(m) AS mean_of_means, CASE WHEN count(*) > 1 THEN arg_max(m, level) - arg_min(m, level) ELSE 0 END AS delta FROM s GROUP BY ALL""",
)
def a23(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("story"), F.col("l_linenumber").alias("level")).agg(F.avg("l_quantity").alias("m"))
    return s.groupBy("story").agg(F.avg("m").alias("mean_of_means"), F.when(F.count("*") > 1, F.max_by("m", "level") - F.min_by("m", "level")).otherwise(0.0).alias("delta"))


@catalogue.add(
    "a24_level_weighted",
    """WITH s AS (SELECT l_suppkey AS grp, l_linenumber AS level, avg(l_discount) AS m FROM lineitem GROUP BY ALL)
       SELECT grp, round(sum(level * m) / sum(level), 4) AS score FROM s GROUP BY grp HAVING count(*) >= 2""",
)
def a24(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("level")).agg(F.avg("l_discount").alias("m"))
    return s.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum(F.col("level") * F.col("m")) / F.sum("level"), 4).alias("score")).filter("n >= 2").drop("n")


@catalogue.add("a28_mean_min_max", f"SELECT task, avg(value) AS mean, min(value) AS low, max(value) AS high FROM ({TIDY_SQL}) GROUP BY ALL")
def a28(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(spark, folder).groupBy("task").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@catalogue.add(
    "a29_collection_levels",
    f"""
    WITH l AS (SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS s, count(c_acctbal) AS n, sum(c_acctbal * (c_custkey % 3)) AS sw, sum(c_custkey % 3) AS w
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
    a AS (SELECT r_name, n_name, c_mktsegment, s / n AS micro, s / n AS macro, sw, w, n FROM l),
    b AS (SELECT r_name, n_name, sum(s) / sum(n) AS micro, (SELECT avg(micro) FROM a WHERE a.r_name = l.r_name AND a.n_name = l.n_name) AS macro, sum(sw) AS sw, sum(w) AS w, sum(n) AS n FROM l GROUP BY ALL),
    c AS (SELECT r_name, sum(s) / sum(n) AS micro, (SELECT avg(micro) FROM b WHERE b.r_name = l.r_name) AS macro, sum(sw) AS sw, sum(w) AS w, sum(n) AS n FROM l GROUP BY ALL)
    SELECT 'c_mktsegment' AS level, r_name || '/' || n_name || '/' || c_mktsegment AS key, {_R4.format('micro')} AS micro, {_R4.format('macro')} AS macro, {_R4.format('CASE WHEN w = 0 THEN micro ELSE sw / w END')} AS weighted, n FROM a
    UNION ALL SELECT 'n_name', r_name || '/' || n_name, {_R4.format('micro')} AS micro, {_R4.format('macro')} AS macro, {_R4.format('CASE WHEN w = 0 THEN micro ELSE sw / w END')} AS weighted, CAST(n AS BIGINT) FROM b
    UNION ALL SELECT 'r_name', r_name, {_R4.format('micro')} AS micro, {_R4.format('macro')} AS macro, {_R4.format('CASE WHEN w = 0 THEN micro ELSE sw / w END')} AS weighted, CAST(n AS BIGINT) FROM c
    """,
)
def a29(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregate.tree_levels(c.withColumn("weight", F.col("c_custkey") % 3), ["r_name", "n_name", "c_mktsegment"], "c_acctbal")


_SUBSETS_SQL = """
    SELECT report_id, model_name, dataset_name, m.name AS metric, c.name AS category, s.name AS subset, s.score AS score, s.num AS num FROM (SELECT report_id, model_name, dataset_name, m, c, unnest(c.subsets) AS s FROM (
        SELECT report_id, model_name, dataset_name, m, unnest(m.categories) AS c FROM (SELECT report_id, model_name, dataset_name, unnest(metrics) AS m FROM reports))) WHERE s IS NOT NULL
"""


def subsets(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reports").select("report_id", "model_name", "dataset_name", F.explode_outer("metrics").alias("m"))
    c = r.select("report_id", "model_name", "dataset_name", F.col("m.name").alias("metric"), F.explode_outer("m.categories").alias("c"))
    s = c.select("report_id", "model_name", "dataset_name", "metric", F.col("c.name").alias("category"), F.explode_outer("c.subsets").alias("s")).filter("s is not null")
    return s.select("report_id", "model_name", "dataset_name", "metric", "category", F.col("s.name").alias("subset"), F.col("s.score").alias("score"), F.col("s.num").alias("num"))


@catalogue.add(
    "a30_report_averages",
    f"SELECT dataset_name, metric, sum(score * num) / nullif(sum(num) FILTER (score IS NOT NULL), 0) AS weighted, avg(score) AS plain, count(score) AS n FROM ({_SUBSETS_SQL}) GROUP BY ALL",
)
def a30(spark: SparkSession, folder: str) -> DataFrame:
    return subsets(spark, folder).groupBy("dataset_name", "metric").agg(
        F.try_divide(F.sum(F.col("score") * F.col("num")), F.sum(F.when(F.col("score").isNotNull(), F.col("num")))).alias("weighted"), F.avg("score").alias("plain"), F.count("score").alias("n")
    )


@catalogue.add("a31_difficulty_weighted", "SELECT l_returnflag, sum(pow(2, level) * s) / 15 AS score FROM (SELECT l_returnflag, l_linenumber - 1 AS level, avg(l_tax) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL) GROUP BY ALL")
def a31(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").filter("l_linenumber <= 4").groupBy("l_returnflag", (F.col("l_linenumber") - 1).alias("level")).agg(F.avg("l_tax").alias("s"))
    return s.groupBy("l_returnflag").agg((F.sum(F.pow(F.lit(2.0), F.col("level")) * F.col("s")) / 15).alias("score"))


@catalogue.add("a32_depth_pivot", "PIVOT (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) ON l_linestatus IN ('F', 'O') USING avg(l_quantity) GROUP BY l_returnflag")
def a32(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))


@catalogue.add(
    "a33_micro_macro",
    f"""WITH s AS (SELECT report_id, metric, category, {_R4.format("coalesce(sum(score * num) / nullif(sum(num) FILTER (score IS NOT NULL), 0), 0)")} AS micro, {_R4.format("coalesce(avg(score), 0)")} AS macro,
        sum(num) FILTER (score IS NOT NULL) AS num FROM ({_SUBSETS_SQL}) GROUP BY ALL)
        SELECT report_id, metric, {_R4.format("coalesce(sum(micro * num) / nullif(sum(num), 0), 0)")} AS micro, {_R4.format("avg(macro)")} AS macro FROM s GROUP BY ALL""",
)
def a33(spark: SparkSession, folder: str) -> DataFrame:
    known = F.sum(F.when(F.col("score").isNotNull(), F.col("num")))
    s = subsets(spark, folder).groupBy("report_id", "metric", "category").agg(
        aggregate.round4(aggregate.ratio(F.sum(F.col("score") * F.col("num")), known)).alias("micro"), aggregate.round4(F.coalesce(F.avg("score"), F.lit(0.0))).alias("macro"), known.alias("num")
    )
    return s.groupBy("report_id", "metric").agg(aggregate.round4(aggregate.ratio(F.sum(F.col("micro") * F.col("num")), F.sum("num"))).alias("micro"), aggregate.round4(F.avg("macro")).alias("macro"))


@catalogue.add(
    "a34_statistics",
    "SELECT event_type, stddev_pop(value) AS sd_pop, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(count(*)) AS stderr, sum(value * user_id) / sum(user_id) AS weighted_mean, exp(-avg(-value / 100)) AS perplexity FROM events GROUP BY ALL",
)
def a34(spark: SparkSession, folder: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    return table(spark, folder, "events").groupBy("event_type").agg(
        F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("stderr"), (F.sum(v * u) / F.sum(u)).alias("weighted_mean"), F.exp(-F.avg(-v / 100)).alias("perplexity")
    )


@catalogue.add(
    "a40_perf_summary",
    """SELECT model_output.model AS model, count(*) AS n, count(*) FILTER (model_output.time > 0 AND NOT isnan(model_output.time)) AS ok, avg(model_output.time) FILTER (model_output.time > 0 AND NOT isnan(model_output.time)) AS mean_time,
        sum(model_output.usage.output_tokens) FILTER (model_output.time > 0 AND NOT isnan(model_output.time)) / sum(model_output.time) FILTER (model_output.time > 0 AND NOT isnan(model_output.time)) AS tokens_a_second FROM predictions GROUP BY ALL""",
)
def a40(spark: SparkSession, folder: str) -> DataFrame:
    t, o = F.col("model_output.time"), F.col("model_output.usage.output_tokens")
    ok = (t > 0) & ~F.isnan(t)
    return table(spark, folder, "predictions").groupBy(F.col("model_output.model").alias("model")).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.avg(F.when(ok, t)).alias("mean_time"), F.try_divide(F.sum(F.when(ok, o)).cast("double"), F.sum(F.when(ok, t))).alias("tokens_a_second")
    )


@catalogue.add(
    "a41_time_per_token",
    "SELECT rec_id, CASE WHEN model_output.usage.output_tokens > 1 AND NOT isnan(model_output.time) THEN (model_output.time - 0.05) / (model_output.usage.output_tokens - 1) END AS tpot FROM predictions",
)
def a41(spark: SparkSession, folder: str) -> DataFrame:
    t, o = F.col("model_output.time"), F.col("model_output.usage.output_tokens")
    return table(spark, folder, "predictions").select("rec_id", F.when((o > 1) & ~F.isnan(t), (t - 0.05) / (o - 1)).alias("tpot"))


@catalogue.add(
    "a42_nearest_rank",
    """SELECT event_type, p, l[CAST(floor(n * p / 100) AS BIGINT) + 1] AS value FROM (SELECT event_type, list_sort(list(value)) AS l, count(value) AS n FROM events GROUP BY ALL),
        (SELECT unnest([10, 25, 50, 66, 75, 80, 90, 95, 98, 99]) AS p)""",
)
def a42(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.nearest_rank(table(spark, folder, "events"), ["event_type"], "value", (10, 25, 50, 66, 75, 80, 90, 95, 98, 99))


@catalogue.add(
    "a43_speed_by_prompt",
    "SELECT model_output.usage.input_tokens AS input_tokens, round(avg(model_output.usage.output_tokens / model_output.time), 2) AS speed FROM predictions WHERE model_output.time > 0 AND NOT isnan(model_output.time) GROUP BY ALL",
)
def a43(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("model_output.time")
    return table(spark, folder, "predictions").filter((t > 0) & ~F.isnan(t)).groupBy(F.col("model_output.usage.input_tokens").alias("input_tokens")).agg(F.round(F.avg(F.col("model_output.usage.output_tokens") / t), 2).alias("speed"))


@catalogue.add(
    "a45_best_config",
    "WITH s AS (SELECT model_output.model AS model, count(*) AS n, sum(model_output.usage.output_tokens) AS tokens FROM predictions GROUP BY ALL) SELECT arg_max(model, (n, model)) AS most_requests, arg_min(model, (tokens, model)) AS fewest_tokens FROM s",
)
def a45(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "predictions").groupBy(F.col("model_output.model").alias("model")).agg(F.count("*").alias("n"), F.sum("model_output.usage.output_tokens").alias("tokens"))
    return s.agg(F.max_by("model", F.struct("n", "model")).alias("most_requests"), F.min_by("model", F.when(F.col("tokens").isNotNull(), F.struct("tokens", "model"))).alias("fewest_tokens"))


@catalogue.add(
    "a46_sla_check",
    """WITH s AS (SELECT user_id, avg(value) AS latency, count(*) AS n, bool_and(value >= 0) AS all_ok FROM events GROUP BY ALL) SELECT user_id, all_ok AND ((latency <= 45 AND n >= 3) OR latency <= 30) AS passed FROM s""",
)
def a46(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "events").groupBy("user_id").agg(F.avg("value").alias("latency"), F.count("*").alias("n"), F.bool_and(F.col("value") >= 0).alias("all_ok"))
    return s.select("user_id", (F.col("all_ok") & (((F.col("latency") <= 45) & (F.col("n") >= 3)) | (F.col("latency") <= 30))).alias("passed"))


@catalogue.add(
    "a48_score_matrix",
    f"""
    WITH m AS (SELECT model, metric, avg(value) AS v FROM ({TIDY_SQL}) WHERE model <> '' GROUP BY ALL),
    n AS (SELECT *, CASE WHEN metric LIKE '%originality%' THEN v WHEN max(v) OVER (PARTITION BY metric) = min(v) OVER (PARTITION BY metric) THEN 1.0
        ELSE (v - min(v) OVER (PARTITION BY metric)) / (max(v) OVER (PARTITION BY metric) - min(v) OVER (PARTITION BY metric)) END AS x, CASE WHEN metric LIKE '%originality%' THEN 2 ELSE 1 END AS w FROM m)
    SELECT model, sum(x * w) / sum(w) AS total, count(*) AS n FROM n GROUP BY ALL
    """,
)
def a48(spark: SparkSession, folder: str) -> DataFrame:
    m = tidy(spark, folder).filter("model <> ''").groupBy("model", "metric").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("metric")  # over one row for each model
    low, high, orig = F.min("v").over(w), F.max("v").over(w), F.contains("metric", F.lit("originality"))
    n = m.select("model", F.when(orig, F.col("v")).when(high == low, 1.0).otherwise((F.col("v") - low) / (high - low)).alias("x"), F.when(orig, 2).otherwise(1).alias("w"))
    return n.groupBy("model").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("total"), F.count("*").alias("n"))


@catalogue.add(
    "a49_latest_review_means",
    """SELECT task, lower(trim(model)) AS model, avg(sample_score.score.value[sample_score.score.main_score_name]) AS score, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY task, lower(trim(model)), sample_index ORDER BY reviewed_at DESC, review_id DESC) AS r FROM reviews) WHERE r = 1 GROUP BY ALL""",
)
def a49(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    r = table(spark, folder, "reviews").select("task", F.lower(F.trim("model")).alias("model"), "sample_index", "reviewed_at", "review_id", F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v"))
    # a struct holds the value, as max_by keeps a null value but a bare max would pass over it
    last = r.groupBy("task", "model", "sample_index").agg(F.max(F.struct("reviewed_at", "review_id", "v")).alias("x"))
    return last.groupBy("task", "model").agg(F.avg("x.v").alias("score"), F.count("*").alias("n"))


@catalogue.add(
    "a50_z_totals",
    f"""WITH m AS (SELECT model, metric, avg(value) AS v FROM ({TIDY_SQL}) GROUP BY ALL), z AS (SELECT model, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM m WINDOW w AS (PARTITION BY metric)) SELECT model, round(avg(z), 6) AS total FROM z GROUP BY ALL""",
)
def a50(spark: SparkSession, folder: str) -> DataFrame:
    m = tidy(spark, folder).groupBy("model", "metric").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("metric")
    z = m.select("model", aggregate.ratio(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)).alias("z"))
    return z.groupBy("model").agg(F.round(F.avg("z"), 6).alias("total"))


@catalogue.add(
    "a51_delta_to_baseline",
    f"""WITH s AS (SELECT task, metric, avg(value) AS mean, coalesce(stddev_pop(value), 0) AS sd, count(*) AS n FROM ({TIDY_SQL}) GROUP BY ALL)
        SELECT s.task, s.metric, s.mean, s.sd, s.n, s.mean - b.mean AS delta FROM s LEFT JOIN s b ON b.metric = s.metric AND b.task = (SELECT min(task) FROM s c WHERE c.metric = s.metric)""",
)
def a51(spark: SparkSession, folder: str) -> DataFrame:
    s = tidy(spark, folder).groupBy("task", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))
    base = F.min_by("mean", "task").over(Window.partitionBy("metric"))
    return s.withColumn("delta", F.col("mean") - base)


@catalogue.add(
    "a52_audit_flags",
    """SELECT task, count(*) AS n, count(*) FILTER (sample_id IS NULL) AS no_id, count(*) FILTER (model_output.usage IS NULL) AS no_usage, count(*) FILTER (metadata IS NULL) AS no_metadata,
        bool_and(sample_id IS NOT NULL AND model_output.usage IS NOT NULL) AS passed FROM predictions GROUP BY ALL""",
)
def a52(spark: SparkSession, folder: str) -> DataFrame:
    usage = F.col("model_output.usage")
    return table(spark, folder, "predictions").groupBy("task").agg(
        F.count("*").alias("n"), F.count_if(F.col("sample_id").isNull()).alias("no_id"), F.count_if(usage.isNull()).alias("no_usage"), F.count_if(F.col("metadata").isNull()).alias("no_metadata"),
        F.bool_and(F.col("sample_id").isNotNull() & usage.isNotNull()).alias("passed"),
    )


@catalogue.add("a57_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a57(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.grouping_id().alias("level"), F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@catalogue.add("a58_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def a58(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
