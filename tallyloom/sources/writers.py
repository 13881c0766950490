"""Writers: append-only caches, JSON lines, CSV, report trees and score matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_cache(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Rows added to a Parquet cache, by folders of ``partitions``, which later reads prune."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def jsonl_to_csv(spark, source: str, target: str) -> None:
    from tallyloom.sources.readers import read_jsonl

    write_csv(read_jsonl(spark, source), target)


def csv_to_jsonl(spark, source: str, target: str) -> None:
    from tallyloom.sources.readers import read_csv

    write_jsonl(read_csv(spark, source), target)


def report_trees(rows: DataFrame) -> DataFrame:
    """(model, dataset, report): rows (model, dataset, metric, category, subset, score, num) as one JSON tree a report.

    Levels carry the number-weighted and the plain mean of what is below them. A report has as many subsets as its
    data set, so its lists are small.
    """
    low = F.collect_list(F.struct("subset", "score", "num"))
    weighted = F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("num")), F.sum("num")), F.lit(0.0))
    c = rows.groupBy("model", "dataset", "metric", "category").agg(weighted.alias("s"), F.avg("score").alias("macro"), F.sum("num").alias("n"), F.array_sort(low).alias("subsets"))
    c = c.select("model", "dataset", "metric", F.struct("category", F.col("s").alias("score"), F.col("macro").alias("macro_score"), F.col("n").alias("num"), "subsets").alias("c"))
    m = c.groupBy("model", "dataset", "metric").agg(
        F.coalesce(F.try_divide(F.sum(F.col("c.score") * F.col("c.num")), F.sum("c.num")), F.lit(0.0)).alias("score"), F.avg("c.macro_score").alias("macro_score"), F.sum("c.num").alias("num"), F.array_sort(F.collect_list("c")).alias("categories")
    )
    t = m.groupBy("model", "dataset").agg(F.array_sort(F.collect_list(F.struct("metric", "score", "macro_score", "num", "categories"))).alias("metrics"))
    return t.select("model", "dataset", F.to_json(F.struct("model", "dataset", F.col("metrics")[0]["score"].alias("score"), "metrics")).alias("report"))


def score_matrix(rows: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A dense matrix of means; missing cells are ''. The columns are given, so no pass is needed to find them."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
