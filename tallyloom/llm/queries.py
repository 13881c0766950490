"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import consensus, mixing, packing, pairs, percentiles, pii, tokens, truncation
from tallyloom.plans.registry import Catalogue, table
from tallyloom.session import durable

catalogue = Catalogue()


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.usable_votes(table(spark, folder, "audit_fulltask_caches"), table(spark, folder, "judge_aliases"))


def _stated_sql(words: str) -> str:
    one = f"({words})(?:[^a-z一-鿿]|$)"
    forms = [
        rf'(?i)"(?:verdict|decision|label|answer|result|judgment|judgement)"\s*:\s*"?{one}',
        rf"(?i)<answer>\s*{one}\s*</answer>",
        rf"(?i)\[\[\s*{one}\s*\]\]",
        rf"(?i)(?:verdict|decision|final answer|answer|判定|结论|答案)(?: is)?[^\w一-鿿]{{1,6}}(?:is )?{one}",
        rf"(?i)(?:evidence supports|i choose|i pick|i conclude|i decide on) {one}",
        rf"(?i)^[^\w一-鿿]*{one}",
    ]
    return "lower(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in forms) + "))"


_VOTES_SQL = f"""
    SELECT sample_key, stage, judge, arg_max(label, (updated_at, vote_id)) AS label FROM (
        SELECT sample_key, stage, judge, updated_at, vote_id, CASE WHEN word IN ('yes', 'true', '是') THEN 'YES' WHEN word IN ('no', 'false', '否') THEN 'NO'
            WHEN word IN ('low', '低') THEN 'LOW' WHEN word IN ('medium', '中') THEN 'MEDIUM' WHEN word IN ('high', '高') THEN 'HIGH' END AS label
        FROM (SELECT *, CASE WHEN stage = 'novelty' THEN {_stated_sql("low|低|medium|中|high|高")} ELSE {_stated_sql("yes|true|是|no|false|否")} END AS word
            FROM (SELECT *, regexp_replace(raw_judge_response, '(?is)<think>.*?</think>', ' ', 'g') AS t FROM audit_fulltask_caches WHERE status = 'success')
            JOIN judge_aliases USING (judge_key)))
    WHERE label IS NOT NULL GROUP BY ALL
"""


@catalogue.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reweighted_consensus(_votes(spark, folder)).items.select("sample_key", "stage", "consensus_label")


@catalogue.add("p1_items")
def p1_items(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reweighted_consensus(_votes(spark, folder)).items.select("sample_key", "stage", "consensus_label", "confidence", "agreement", "n_votes")


@catalogue.add("p1_judges")
def p1_judges(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reweighted_consensus(_votes(spark, folder)).judges


@catalogue.add("p1_votes", _VOTES_SQL)
def p1_votes(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder)


@catalogue.add(
    "p1_agreement",
    f"""
    WITH v AS (SELECT stage, sample_key, label, count(*) AS c FROM ({_VOTES_SQL}) GROUP BY ALL),
    u AS (SELECT stage, sample_key, sum(c) AS m, sum(c * c) AS sq FROM v GROUP BY ALL HAVING sum(c) >= 2),
    w AS (SELECT stage, count(*) AS n_items, sum(m) AS n_votes, sum((m * m - sq) / (m - 1)) AS within FROM u GROUP BY ALL),
    t AS (SELECT stage, sum(c * c) AS sq FROM (SELECT stage, label, sum(c) AS c FROM v SEMI JOIN u USING (stage, sample_key) GROUP BY ALL) GROUP BY ALL)
    SELECT stage, n_items, CAST(n_votes AS BIGINT) AS n_votes, within / n_votes AS observed, (n_votes * n_votes - sq) / (n_votes * (n_votes - 1)) AS expected,
        1 - (within / n_votes) / ((n_votes * n_votes - sq) / (n_votes * (n_votes - 1))) AS alpha
    FROM w JOIN t USING (stage)
    """,
)
def p1_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.krippendorff_alpha(_votes(spark, folder), ["stage"], ["sample_key"])


def _day_states(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.value_counts(
        table(spark, folder, "predictions"),
        {"day": F.to_date("written_at"), "model": F.col("model_output.model")},
        {"output_tokens": F.col("model_output.usage.output_tokens"), "time": F.col("model_output.time")},
    )


_STATES_SQL = """
    SELECT day, model, metric, CASE WHEN x = 0 OR isinf(x) THEN x ELSE sign(x) * CASE WHEN e < 0 THEN round(abs(x) * pow(10.0, -e)) / pow(10.0, -e)
        ELSE round(abs(x) / pow(10.0, e)) * pow(10.0, e) END END AS value, count(*) AS n
    FROM (SELECT *, CASE WHEN x <> 0 AND NOT isinf(x) THEN floor(log10(abs(x))) - 2 END AS e FROM (
        SELECT CAST(written_at AS DATE) AS day, model_output.model AS model, 'output_tokens' AS metric, CAST(model_output.usage.output_tokens AS DOUBLE) AS x FROM predictions
        UNION ALL SELECT CAST(written_at AS DATE), model_output.model, 'time', model_output.time FROM predictions) WHERE x IS NOT NULL AND NOT isnan(x))
    GROUP BY ALL
"""


@catalogue.add(
    "p2_percentiles",
    f"""
    WITH d AS (SELECT CAST(day AS VARCHAR) AS days, model, metric, value, n FROM ({_STATES_SQL})),
    s AS (SELECT days, model, metric, value, n FROM d UNION ALL SELECT 'all', model, metric, value, sum(n) FROM d GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY days, model, metric ORDER BY value) AS running, sum(n) OVER (PARTITION BY days, model, metric) AS total FROM s)
    SELECT days, model, metric, p, min(value) AS value, CAST(max(total) AS BIGINT) AS n, 0.005 AS max_rel_error
    FROM r, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0]) AS p) WHERE running >= greatest(1, ceil(p * total / 100.0)) GROUP BY ALL
    """,
)
def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Of each day, and of all days by merging the days' states."""
    states = durable(_day_states(spark, folder), "states")
    days = states.withColumn("days", F.col("day").cast("string")).drop("day")
    every = percentiles.merge(states, ["model"]).withColumn("days", F.lit("all"))
    return percentiles.percentiles(days.unionByName(every), ["days", "model"])


@catalogue.add("p2_day_states", _STATES_SQL)
def p2_day_states(spark: SparkSession, folder: str) -> DataFrame:
    return _day_states(spark, folder)


@catalogue.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_messages(table(spark, folder, "predictions")).filter("is_cut").select("rec_id", "msg_pos")


@catalogue.add("p3_by_model")
def p3_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(truncation.cut_messages(table(spark, folder, "predictions")), "model")


@catalogue.add("p3_by_run")
def p3_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_rates(truncation.cut_messages(table(spark, folder, "predictions")), "run_dir")


@catalogue.add("p3_limits")
def p3_limits(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.hidden_limits(truncation.inspected(table(spark, folder, "predictions")))


@catalogue.add("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.main_defect(pairs.defects(table(spark, folder, "reviews")))


@catalogue.add("p4_labels")
def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(table(spark, folder, "reviews")).drop("cutoff", "pattern")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.sized(table(spark, folder, "documents")), table(spark, folder, "pack_sizes"))


@catalogue.add("p6_assignments")
def p6_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@catalogue.add("p6_fill")
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.mix(tokens.sized(table(spark, folder, "documents"), "source"), table(spark, folder, "mix_targets"))


@catalogue.add("p7_mixture")
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).rows


@catalogue.add("p7_shares")
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares


@catalogue.add("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.items(pii.spans(table(spark, folder, "documents")))


@catalogue.add("p8_redacted")
def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return pii.redacted(documents, durable(pii.spans(documents), "spans"))
