"""Joins, windows, limits, set operations and reshapes (inventory J, W, L, U, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import scoring
from tallyloom.operators import caches, retrieval, sampling
from tallyloom.plans.aggregates import TIDY_SQL, subsets, tidy
from tallyloom.plans.registry import Catalogue, table

catalogue = Catalogue()

_MODEL = "lower(trim(model))"
_ONE = f"SELECT task, sample_index, {_MODEL} AS model, avg(sample_score.score.value[sample_score.score.main_score_name]) AS score FROM reviews GROUP BY ALL"


def _one_score(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    r = table(spark, folder, "reviews").select("task", "sample_index", F.lower(F.trim("model")).alias("model"), F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v"))
    return r.groupBy("task", "sample_index", "model").agg(F.avg("v").alias("score"))


@catalogue.add(
    "j01_compare_models",
    f"WITH s AS ({_ONE}) SELECT a.task, a.sample_index, a.score AS a_score, b.score AS b_score FROM s a JOIN s b USING (task, sample_index) WHERE a.model = 'quillon-9b-chat' AND b.model = ''",
)
def j01(spark: SparkSession, folder: str) -> DataFrame:
    s = _one_score(spark, folder)
    a = s.filter("model = 'quillon-9b-chat'").select("task", "sample_index", F.col("score").alias("a_score"))
    return a.join(s.filter("model = ''").select("task", "sample_index", F.col("score").alias("b_score")), ["task", "sample_index"])


@catalogue.add("j02_cached_and_remaining", "SELECT task, count(*) FILTER (rec_id IN (SELECT rec_id FROM reviews)) AS cached, count(*) FILTER (rec_id NOT IN (SELECT rec_id FROM reviews WHERE rec_id IS NOT NULL)) AS remaining FROM predictions GROUP BY ALL")
def j02(spark: SparkSession, folder: str) -> DataFrame:
    p, r = table(spark, folder, "predictions").select("task", "rec_id"), table(spark, folder, "reviews").select("rec_id")
    cached, rest = caches.split_cached(p, r, ["rec_id"])
    both = cached.select("task", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(rest.select("task", F.lit(0).alias("c"), F.lit(1).alias("r")))
    return both.groupBy("task").agg(F.sum("c").alias("cached"), F.sum("r").alias("remaining"))


@catalogue.add(
    "j04_multi_key_lookup",
    """WITH k AS (SELECT key, max(v) AS v FROM (SELECT sample_key AS key, 'key:' || min(vote_id) AS v FROM audit_fulltask_caches WHERE sample_key IS NOT NULL GROUP BY 1) GROUP BY ALL)
       SELECT rec_id, coalesce(a.v, b.v) AS hit FROM predictions LEFT JOIN k a ON sample_key = a.key LEFT JOIN k b ON task || '-' || sample_id = b.key""",
)
def j04(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "audit_fulltask_caches").filter("sample_key is not null").groupBy(F.col("sample_key").alias("key")).agg(F.concat(F.lit("key:"), F.min("vote_id")).alias("hit"))
    p = table(spark, folder, "predictions").select("rec_id", F.array("sample_key", F.concat_ws("-", "task", F.col("sample_id"))).alias("keys"))
    return caches.first_match(p, "rec_id", "keys", known, "key", "hit")


@catalogue.add("j05_left_with_default", "SELECT rec_id, coalesce(f.family, 'unknown') AS family FROM predictions LEFT JOIN model_cards f ON lower(trim(predictions.model)) = f.model")
def j05(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "predictions").select("rec_id", F.lower(F.trim("model")).alias("model"))
    return p.join(table(spark, folder, "model_cards").select("model", "family"), "model", "left").select("rec_id", F.coalesce("family", F.lit("unknown")).alias("family"))


@catalogue.add("j08_common_datasets", "WITH d AS (SELECT DISTINCT dataset_name, model_name FROM reports) SELECT dataset_name, count(*) AS n_models, count(*) = (SELECT count(DISTINCT model_name) FROM d) AS common FROM d GROUP BY ALL")
def j08(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "reports").select("dataset_name", "model_name").distinct()
    total = d.agg(F.count_distinct("model_name").alias("all"))  # one row
    return d.groupBy("dataset_name").agg(F.count("*").alias("n_models")).crossJoin(F.broadcast(total)).select("dataset_name", "n_models", (F.col("n_models") == F.col("all")).alias("common"))


@catalogue.add(
    "j10_prediction_review_audit",
    """WITH p AS (SELECT task, sample_index, count(*) AS n_predictions FROM predictions GROUP BY ALL), r AS (SELECT task, sample_index, count(*) AS n_reviews FROM reviews GROUP BY ALL)
       SELECT coalesce(p.task, r.task) AS task, coalesce(p.sample_index, r.sample_index) AS sample_index, coalesce(n_predictions, 0) AS n_predictions, coalesce(n_reviews, 0) AS n_reviews
       FROM p FULL JOIN r ON p.task = r.task AND p.sample_index = r.sample_index WHERE coalesce(n_predictions, 0) <> coalesce(n_reviews, 0)""",
)
def j10(spark: SparkSession, folder: str) -> DataFrame:
    return caches.audit(table(spark, folder, "predictions"), table(spark, folder, "reviews"), ["task", "sample_index"])


@catalogue.add(
    "j11_judge_progress",
    """WITH w AS (SELECT DISTINCT sample_key, stage FROM audit_fulltask_caches), d AS (SELECT stage, count(DISTINCT judge) AS n FROM audit_fulltask_caches JOIN judge_aliases USING (judge_key) GROUP BY ALL),
       s AS (SELECT sample_key, stage, count(DISTINCT judge) AS done FROM audit_fulltask_caches JOIN judge_aliases USING (judge_key) WHERE status = 'success' GROUP BY ALL)
       SELECT w.sample_key, w.stage, n - coalesce(done, 0) AS missing FROM w JOIN d USING (stage) LEFT JOIN s ON s.sample_key = w.sample_key AND s.stage = w.stage""",
)
def j11(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "audit_fulltask_caches").select("sample_key", "stage", "judge_key", "status").join(table(spark, folder, "judge_aliases"), "judge_key", "left")
    expected = a.groupBy("stage").agg(F.count_distinct("judge").alias("n"))
    done = a.groupBy("sample_key", "stage").agg(F.count_distinct(F.when(F.col("status") == "success", F.col("judge"))).alias("done"))
    return done.join(expected, "stage").select("sample_key", "stage", (F.col("n") - F.col("done")).alias("missing"))


@catalogue.add(
    "j12_nearest_center",
    """WITH c AS (SELECT label, avg(e) AS x, i FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
       k AS (SELECT label, list(x ORDER BY i) AS center FROM c GROUP BY label),
       d AS (SELECT vec_id, k.label, list_distance(embedding::DOUBLE[], center) AS d FROM embeddings, k)
       SELECT vec_id, arg_min(label, d) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY ALL""",
)
def j12(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    # all centers as one row: as many as there are labels, one vector each
    one = centers.agg(F.collect_list(F.struct("label", "center")).alias("centers"))
    d = e.crossJoin(F.broadcast(one)).select("vec_id", F.array_min(F.transform("centers", lambda c: F.struct(scoring.euclidean(F.col("embedding"), c["center"]).alias("d"), c["label"].alias("label")))).alias("m"))
    return d.select("vec_id", F.col("m.label").alias("nearest"), F.round("m.d", 6).alias("distance"))


@catalogue.add("j13_pairs_in_row", "WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, a || '+' || b AS pair FROM (SELECT p_partkey, w[i] AS a, w[j] AS b FROM (SELECT p_partkey, w, unnest(generate_series(1, len(w))) AS i FROM x), (SELECT unnest(generate_series(1, 12)) AS j) WHERE j > i AND j <= len(w))")
def j13(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.concat(x, F.lit("+"), y))))
    return w.select("p_partkey", F.explode(pairs).alias("pair"))


@catalogue.add(
    "j14_similarity_top_k",
    """WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
       SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
)
def j14(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return retrieval.top_k(e.filter("vec_id % 50 = 0"), e, 10).withColumn("score", F.round("score", 6))


@catalogue.add(
    "a54_retrieval_metrics",
    """WITH s AS (SELECT q.vec_id AS query_id, q.label = r.label AS rel, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS score, r.vec_id AS id FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
       t AS (SELECT query_id, count(*) FILTER (rel) AS m FROM s GROUP BY ALL HAVING m > 0),
       h AS (SELECT query_id, rel::INT AS rel, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10),
       g AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h)
       SELECT query_id, sum(rel / log2(rank + 1)) / list_sum(list_transform(generate_series(1, least(m, 10)), lambda i: 1 / log2(i + 1))) AS ndcg, sum(rel * seen / rank) / least(m, 10) AS ap, sum(rel) / m AS recall, sum(rel) / 10 AS precision,
           max(rel / rank)::DOUBLE AS mrr FROM g JOIN t USING (query_id) GROUP BY query_id, m""",
)
def a54(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    q = e.filter("vec_id % 50 = 0")
    found = retrieval.top_k(q, e, 10)
    of = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = found.join(of, "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "id", "rank", (F.col("wanted") == F.col("label")).cast("double").alias("rel"))
    # every other row of the query's label is relevant: they are counted by label, never paired with the queries
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("m"))
    totals = of.join(sizes, of["wanted"] == sizes["label"]).filter("m > 0").select("query_id", "m")
    return retrieval.graded_metrics(hits, totals, 10)


@catalogue.add("j16_category_map", "SELECT task, coalesce(c.cat, 'default') AS category, count(*) AS n FROM reviews LEFT JOIN (VALUES ('neocoder', 'code'), ('general_qa', 'qa'), ('bats', 'words')) c(t, cat) ON task = c.t GROUP BY ALL")
def j16(spark: SparkSession, folder: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("neocoder", "code", "general_qa", "qa", "bats", "words")])
    return table(spark, folder, "reviews").groupBy("task", F.coalesce(F.try_element_at(names, F.col("task")), F.lit("default")).alias("category")).agg(F.count("*").alias("n"))


@catalogue.add("j17_done_models", "WITH t AS (SELECT DISTINCT task FROM reviews) SELECT model FROM (SELECT lower(trim(model)) AS model, count(DISTINCT task) AS n FROM reviews GROUP BY ALL) WHERE n = (SELECT count(*) FROM t)")
def j17(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reviews").select(F.lower(F.trim("model")).alias("model"), "task").distinct()
    wanted = r.agg(F.count_distinct("task").alias("all"))  # one row
    return r.groupBy("model").agg(F.count("*").alias("n")).crossJoin(F.broadcast(wanted)).filter("n = all").select("model")


@catalogue.add("j18_as_of", "SELECT e.event_id, o.o_orderkey FROM (SELECT * FROM events WHERE event_id IS NOT NULL) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def j18(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", "ts")
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return caches.as_of(e, o, ["user_id"], "ts", "o_orderkey", "event_id")


@catalogue.add(
    "w02_quantile_rank",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) <= 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) END AS q FROM lineitem",
)
def w02(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.count("*").over(w) <= 1, 0.5).otherwise(F.percent_rank().over(w.orderBy("l_quantity"))).alias("q"))


@catalogue.add("w04_latest_vote", "SELECT sample_key, stage, judge_key, vote_id, status FROM audit_fulltask_caches QUALIFY row_number() OVER (PARTITION BY sample_key, stage, judge_key ORDER BY updated_at DESC, vote_id DESC) = 1")
def w04(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "audit_fulltask_caches").select("sample_key", "stage", "judge_key", "updated_at", "vote_id", "status")
    return caches.latest(a, ["sample_key", "stage", "judge_key"], ["updated_at", "vote_id"]).drop("updated_at")


@catalogue.add("w05_min_max", f"WITH m AS (SELECT task, metric, avg(value) AS v FROM ({TIDY_SQL}) GROUP BY ALL) SELECT task, metric, coalesce((v - min(v) OVER (PARTITION BY metric)) / nullif(max(v) OVER (PARTITION BY metric) - min(v) OVER (PARTITION BY metric), 0), 1.0) AS scaled FROM m")
def w05(spark: SparkSession, folder: str) -> DataFrame:
    m = tidy(spark, folder).groupBy("task", "metric").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("metric")
    return m.select("task", "metric", F.coalesce(F.try_divide(F.col("v") - F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)), F.lit(1.0)).alias("scaled"))


@catalogue.add("w07_differences", "SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def w07(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", "event_id", (F.col("value") - F.lag("value").over(w)).alias("delta"))


@catalogue.add("w08_running_sum", "SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM events")
def w08(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, folder, "events").select("user_id", "event_id", F.sum("event_id").over(w).alias("total"))


@catalogue.add("w09_group_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) - 1 AS grp FROM lineitem")
def w09(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    # ranks over the few distinct keys, joined back, in place of one task that sorts all rows
    keys = li.select("l_returnflag", "l_linestatus").distinct().withColumn("grp", F.dense_rank().over(Window.orderBy("l_returnflag", "l_linestatus")) - 1)
    return li.join(keys, ["l_returnflag", "l_linestatus"], "left").select("l_orderkey", "l_linenumber", "l_partkey", "grp")


@catalogue.add("w10_group_value", "SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS share FROM orders")
def w10(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    totals = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("t"))
    return o.join(totals, "o_orderpriority", "left").select("o_orderkey", (F.col("o_totalprice") / F.col("t")).alias("share"))


@catalogue.add("l01_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def l01(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@catalogue.add("l02_repeats", "SELECT p_partkey, g - 1 AS grp, k AS repeat, (g - 1) * 3 + k AS id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS g FROM part), (SELECT unnest([0, 1, 2]) AS k)")
def l02(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.repeated(table(spark, folder, "part").select("p_partkey"), 3, "p_partkey").withColumnRenamed("group", "grp")


@catalogue.add("l06_top_in_row", "SELECT vec_id, round(list_sum(list_reverse_sort(embedding::DOUBLE[])[1:3]), 6) AS top FROM embeddings")
def l06(spark: SparkSession, folder: str) -> DataFrame:
    best = F.slice(F.sort_array("embedding", False), 1, 3)
    return table(spark, folder, "embeddings").select("vec_id", F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), 6).alias("top"))


@catalogue.add(
    "l09_quotas",
    """WITH s AS (SELECT coalesce(lang, 'none') AS dataset, count(*) AS n, count(DISTINCT source) AS weight FROM documents GROUP BY ALL),
       q AS (SELECT *, floor(weight / sum(weight) OVER () * 300) AS base, dataset = max(dataset) OVER () AS last FROM s)
       SELECT dataset, n, least(n, CASE WHEN last THEN 300 - sum(CASE WHEN last THEN 0 ELSE base END) OVER () ELSE base END)::BIGINT AS quota FROM q""",
)
def l09(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "documents").groupBy(F.coalesce("lang", F.lit("none")).alias("dataset")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("weight"))
    return sampling.quotas(s, 300, "weighted")


@catalogue.add("l11_sampled")
def l11(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    s = d.groupBy(F.col("lang").alias("dataset")).agg(F.count("*").alias("n"), F.lit(1).alias("weight"))
    return sampling.sampled(d, sampling.quotas(s, 300, "stratified"), "lang", "doc_id")


@catalogue.add(
    "l08_picks",
    """SELECT task, review_id, CASE WHEN r = 0 THEN 'near' WHEN r = n // 2 THEN 'middle' ELSE 'far' END AS pick FROM (SELECT task, review_id, row_number() OVER (PARTITION BY task ORDER BY review_id) - 1 AS r, count(*) OVER (PARTITION BY task) AS n FROM reviews)
       WHERE r IN (0, n // 2, n - 1)""",
)
def l08(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.picks(table(spark, folder, "reviews").select("task", "review_id"), "task", ["review_id"])


@catalogue.add("l10_first_per_group", "SELECT coalesce(lang, 'default') AS lang, doc_id, r - 1 AS id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(lang, 'default') ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def l10(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.first_per_group(table(spark, folder, "documents").select("lang", "doc_id"), "lang", ["doc_id"], 5)


@catalogue.add("l14_cyclic_replay", "WITH n AS (SELECT count(*) AS c FROM region) SELECT i, r_name FROM (SELECT unnest(generate_series(0, 999)) AS i), n, region WHERE r_regionkey = i % c")
def l14(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "region")
    total = r.agg(F.count("*").alias("c"))  # one row
    return spark.range(1000).withColumnRenamed("id", "i").crossJoin(F.broadcast(total)).join(r, F.pmod("i", "c") == F.col("r_regionkey")).select("i", "r_name")


@catalogue.add("l15_grid", "SELECT CAST(round(1000 + i * (32000 - 1000) / 9.0) AS BIGINT) AS length, CAST(round(j * 100 / 9.0) AS BIGINT) AS depth FROM (SELECT unnest(generate_series(0, 9)) AS i), (SELECT unnest(generate_series(0, 9)) AS j)")
def l15(spark: SparkSession, folder: str) -> DataFrame:
    g = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"))
    return g.select(F.round(1000 + F.col("i") * 31000 / 9.0).cast("bigint").alias("length"), F.round(F.col("j") * 100 / 9.0).cast("bigint").alias("depth"))


@catalogue.add("u01_union", "SELECT name, 'customer' AS kind FROM (SELECT c_name AS name FROM customer) UNION ALL SELECT s_name, 'supplier' FROM supplier")
def u01(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")), allowMissingColumns=True)


@catalogue.add("u02_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u02(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, folder, "supplier").select("s_nationkey"))


@catalogue.add("u03_except", "SELECT rec_id FROM predictions EXCEPT ALL SELECT rec_id FROM reviews")
def u03(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").select("rec_id").exceptAll(table(spark, folder, "reviews").select("rec_id"))


@catalogue.add("u04_distinct_pairs", "SELECT DISTINCT task, lower(trim(model)) AS model FROM predictions")
def u04(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").select("task", F.lower(F.trim("model")).alias("model")).dropDuplicates(["task", "model"])


@catalogue.add("u05_first_seen", "SELECT task, min(rec_id) AS at FROM predictions GROUP BY ALL")
def u05(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "predictions").groupBy("task").agg(F.min("rec_id").alias("at"))


@catalogue.add("u06_normalised_distinct", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')))")
def u06(spark: SparkSession, folder: str) -> DataFrame:
    k = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " ")))
    return table(spark, folder, "documents").filter("text is not null").groupBy(k.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


_SUBS = """SELECT report_id, model_name, dataset_name, m.name AS metric, c.name AS category, s.name AS subset, s.score AS score, s.num AS num FROM (SELECT report_id, model_name, dataset_name, m, c, unnest(c.subsets) AS s FROM (
    SELECT report_id, model_name, dataset_name, m, unnest(m.categories) AS c FROM (SELECT report_id, model_name, dataset_name, unnest(metrics) AS m FROM reports))) WHERE s IS NOT NULL"""


@catalogue.add(
    "r01_report_rows",
    f"""WITH s AS ({_SUBS}) SELECT report_id, metric, subset, score, num FROM s
        UNION ALL SELECT report_id, metric, 'OVERALL', round(sum(score * num) / nullif(sum(num) FILTER (score IS NOT NULL), 0), 6), CAST(sum(num) AS BIGINT) FROM s GROUP BY report_id, metric HAVING count(*) > 1""",
)
def r01(spark: SparkSession, folder: str) -> DataFrame:
    s = subsets(spark, folder).select("report_id", "metric", "subset", "score", "num")
    known = F.sum(F.when(F.col("score").isNotNull(), F.col("num")))
    g = s.groupBy("report_id", "metric").agg(F.count("*").alias("n"), F.round(F.try_divide(F.sum(F.col("score") * F.col("num")), known), 6).alias("score"), F.sum("num").alias("num"))
    return s.unionByName(g.filter("n > 1").select("report_id", "metric", F.lit("OVERALL").alias("subset"), "score", "num"))


@catalogue.add("r03_category_columns", f"SELECT report_id, metric, subset, category[1] AS cat0, category[2] AS cat1 FROM ({_SUBS})")
def r03(spark: SparkSession, folder: str) -> DataFrame:
    return subsets(spark, folder).select("report_id", "metric", "subset", F.get("category", F.lit(0)).alias("cat0"), F.get("category", F.lit(1)).alias("cat1"))


@catalogue.add(
    "r04_report_tree",
    """SELECT dataset_name, model_name, count(*) AS n_metrics, string_agg(name || '=' || n, ',' ORDER BY name) AS tree FROM (SELECT dataset_name, model_name, 'mean_' || metric AS name, count(*) AS n FROM (
        SELECT task AS dataset_name, lower(trim(model)) AS model_name, unnest(map_keys(sample_score.score.value)) AS metric FROM reviews) GROUP BY ALL) GROUP BY ALL""",
)
def r04(spark: SparkSession, folder: str) -> DataFrame:
    m = tidy(spark, folder).groupBy(F.col("task").alias("dataset_name"), F.col("model").alias("model_name"), F.concat(F.lit("mean_"), "metric").alias("name")).agg(F.count("*").alias("n"))
    t = m.groupBy("dataset_name", "model_name").agg(F.count("*").alias("n_metrics"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("x"))
    return t.select("dataset_name", "model_name", "n_metrics", F.array_join(F.transform("x", lambda s: F.concat(s["name"], F.lit("="), s["n"])), ",").alias("tree"))


@catalogue.add("r05_model_by_dataset", "PIVOT (SELECT lower(trim(model)) AS model, task, sample_score.score.value[sample_score.score.main_score_name] AS v FROM reviews) ON task USING avg(v) GROUP BY model")
def r05(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sample_score.score")
    r = table(spark, folder, "reviews").select(F.lower(F.trim("model")).alias("model"), "task", F.try_element_at(s.getField("value"), s.getField("main_score_name")).alias("v"))
    return r.groupBy("model").pivot("task").agg(F.avg("v"))


@catalogue.add(
    "r06_leaderboard",
    "WITH s AS (SELECT lower(trim(model)) AS model, avg(sample_score.score.value[sample_score.score.main_score_name]) AS score FROM reviews GROUP BY ALL) SELECT m.model, round(coalesce(s.score, 0.5), 6) AS score, rank() OVER (ORDER BY round(coalesce(s.score, 0.5), 6) DESC) AS place FROM model_cards m LEFT JOIN s USING (model)",
)
def r06(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reviews").select(F.lower(F.trim("model")).alias("model"), F.try_element_at("sample_score.score.value", F.col("sample_score.score.main_score_name")).alias("v"))
    g = table(spark, folder, "model_cards").select("model").join(r.groupBy("model").agg(F.avg("v").alias("score")), "model", "left").select("model", F.round(F.coalesce("score", F.lit(0.5)), 6).alias("score"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))  # one row a model


@catalogue.add("r09_zip_lists", "SELECT l_orderkey, unnest(a) AS part, unnest(b) AS qty FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS a, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS b FROM lineitem GROUP BY ALL)")
def r09(spark: SparkSession, folder: str) -> DataFrame:
    # an order has a handful of lines, so its lists are small
    g = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    z = g.select("l_orderkey", F.arrays_zip(F.col("x.l_partkey").alias("part"), F.col("x.l_quantity").alias("qty")).alias("z"))
    return z.select("l_orderkey", F.inline("z"))


@catalogue.add("r10_explode_tags", "SELECT tag, count(*) AS n, avg(p_retailprice) AS price FROM (SELECT unnest(string_split(p_type, ' ')) AS tag, p_retailprice FROM part) WHERE tag IS NOT NULL GROUP BY ALL")
def r10(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "part").select(F.explode_outer(F.split("p_type", " ")).alias("tag"), "p_retailprice").filter("tag is not null")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.avg("p_retailprice").alias("price"))


@catalogue.add("r11_metric_map", "SELECT report_id, list_first(list_filter(metrics, lambda m: m.name = 'mean_acc')).score AS acc FROM reports")
def r11(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports").select("report_id", F.get(F.filter("metrics", lambda m: m["name"] == "mean_acc"), F.lit(0))["score"].alias("acc"))


@catalogue.add("r13_flatten_positions", "SELECT report_id, i, m.name AS name FROM (SELECT report_id, generate_subscripts(metrics, 1) - 1 AS i, unnest(metrics) AS m FROM reports)")
def r13(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reports").select("report_id", F.posexplode("metrics").alias("i", "m")).select("report_id", "i", F.col("m.name").alias("name"))


@catalogue.add("r14_expand_counts", "SELECT s_suppkey, unnest(generate_series(1, s_suppkey % 4)) AS k FROM supplier")
def r14(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("s_suppkey") % 4
    return table(spark, folder, "supplier").filter(n > 0).select("s_suppkey", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("k"))


@catalogue.add("q01_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def q01(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n")
    )
