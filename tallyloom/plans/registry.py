"""The catalogue of named queries: a callable for Spark and, where SQL can say the same, its ANSI text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    """Queries by name. ``sql`` is missing where an operator can't be stated in SQL or not over whole tables."""

    run: dict[str, Run] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def register(f: Run) -> Run:
            if name in self.run:
                raise ValueError(f"query {name} is registered twice")
            self.run[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder; only the columns and rows that the plan asks for are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
