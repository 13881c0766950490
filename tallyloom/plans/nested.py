"""Queries that flatten nested records (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import nested
from tallyloom.plans.registry import Catalogue, table

catalogue = Catalogue()

_PARTS_SQL = """
    SELECT rec_id, i, role, CASE
        WHEN content IS NULL OR content = '' THEN []::JSON[]
        WHEN json_valid(content) AND json_type(content) = 'ARRAY' AND len(list_filter(json_extract(content, '$[*]'), lambda e:
            NOT (json_type(e) = 'NULL' OR (json_type(e) = 'OBJECT' AND list_contains(json_keys(e), 'type'))))) = 0 THEN json_extract(content, '$[*]')
        ELSE ['{}'::JSON] END AS parts
    FROM (SELECT rec_id, generate_subscripts(messages, 1) - 1 AS i, unnest(messages).role AS role, unnest(messages).content AS content FROM predictions)
"""
_SUBSETS_SQL = """
    SELECT report_id, i, j, generate_subscripts(c.subsets, 1) - 1 AS k, m.name AS metric, unnest(c.subsets) AS s FROM (
        SELECT report_id, i, m, generate_subscripts(m.categories, 1) - 1 AS j, unnest(m.categories) AS c FROM (
            SELECT report_id, generate_subscripts(metrics, 1) - 1 AS i, unnest(metrics) AS m FROM reports))
"""


@catalogue.add(
    "p5_found",
    f"""
    SELECT 'predictions' AS tbl, rec_id AS parent_id, 'usage' AS path FROM predictions WHERE model_output.usage.input_tokens IS NOT NULL
    UNION ALL
    SELECT 'predictions', rec_id, 'messages[' || i || '].content[' || j || ']' FROM (
        SELECT rec_id, i, generate_subscripts(parts, 1) - 1 AS j, unnest(parts) AS e FROM ({_PARTS_SQL})) WHERE e IS NOT NULL AND json_type(e) <> 'NULL'
    UNION ALL
    SELECT 'reports', report_id, 'metrics[' || i || '].categories[' || j || '].subsets[' || k || ']' FROM ({_SUBSETS_SQL}) WHERE s IS NOT NULL
    """,
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flat_paths(table(spark, folder, "predictions"), table(spark, folder, "reports"))


@catalogue.add(
    "p5_subsets",
    f"""SELECT report_id AS parent_id, 'metrics[' || i || '].categories[' || j || '].subsets[' || k || ']' AS path,
        report_id || ':metrics[' || i || '].categories[' || j || '].subsets[' || k || ']' AS row_key, report_id || ':metrics[' || i || '].categories[' || j || ']' AS parent_key, s.name AS name, s.score AS score, s.num AS num FROM ({_SUBSETS_SQL}) WHERE s IS NOT NULL""",
)
def p5_subsets(spark: SparkSession, folder: str) -> DataFrame:
    return nested.report_tables(table(spark, folder, "reports"))["reports.metrics.categories.subsets"].drop("ordinals")


@catalogue.add(
    "p5_parts",
    f"""
    SELECT rec_id AS parent_id, 'messages[' || i || '].content[' || j || ']' AS path, e ->> '$.type' AS type FROM (
        SELECT rec_id, i, generate_subscripts(parts, 1) - 1 AS j, unnest(parts) AS e FROM ({_PARTS_SQL})) WHERE e IS NOT NULL AND json_type(e) <> 'NULL'
    """,
)
def p5_parts(spark: SparkSession, folder: str) -> DataFrame:
    return nested.prediction_tables(table(spark, folder, "predictions"))["predictions.messages.content"].select("parent_id", "path", "type")


@catalogue.add("p5_part_fields")
def p5_part_fields(spark: SparkSession, folder: str) -> DataFrame:
    """p5_parts with every field that parts have in the table."""
    return nested.prediction_tables(table(spark, folder, "predictions"))["predictions.messages.content"].drop("ordinals")


@catalogue.add(
    "p5_metadata",
    """SELECT rec_id AS parent_id, metadata ->> '$.lang' AS lang, CAST(metadata ->> '$.level' AS BIGINT) AS level, CAST(metadata ->> '$.orig_index' AS BIGINT) AS orig_index FROM predictions""",
)
def p5_metadata(spark: SparkSession, folder: str) -> DataFrame:
    flat = nested.json_tables(table(spark, folder, "predictions"), "rec_id", "metadata")["json"]
    return flat.select("parent_id", *[F.col(f"fields_{c}").alias(c) for c in ("lang", "level", "orig_index")])
