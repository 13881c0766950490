"""Queries that run through Structured Streaming (inventory T), each over all files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.registry import Catalogue
from tallyloom.streaming import live

catalogue = Catalogue()


@catalogue.add("t01_live_counters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def t01(spark: SparkSession, folder: str) -> DataFrame:
    out = live.run_once(live.counters(live.file_stream(spark, folder, "events"), "event_type", "value"))
    return out.withColumn("total", F.round("total", 4))


@catalogue.add("t05_first_seen", "SELECT task, count(DISTINCT sample_index) AS n FROM reviews GROUP BY ALL")
def t05(spark: SparkSession, folder: str) -> DataFrame:
    stream = live.file_stream(spark, folder, "reviews").select("task", "sample_index")
    return live.run_once(live.first_seen(stream, ["task", "sample_index"]), "append").groupBy("task").agg(F.count("*").alias("n"))


@catalogue.add("t06_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t06(spark: SparkSession, folder: str) -> DataFrame:
    out = live.run_once(live.windowed(live.file_stream(spark, folder, "events"), "ts", "event_type", "value"))
    return out.withColumns({"total": F.round("total", 4), "start": F.col("start").cast("timestamp_ntz")})


@catalogue.add(
    "t06_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
       SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, user_id, count(*) AS n FROM s GROUP BY user_id, s""",
)
def t06_sessions(spark: SparkSession, folder: str) -> DataFrame:
    # all rows count, however late; in complete mode the state is kept anyway
    out = live.run_once(live.sessions(live.file_stream(spark, folder, "events"), "ts", "user_id", late="36500 days"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@catalogue.add("t07_online_ratings")
def t07(spark: SparkSession, folder: str) -> DataFrame:
    e = live.file_stream(spark, folder, "events")
    names = F.array(*[F.lit(f"m{i}") for i in range(8)])
    battles = e.select(
        (F.col("user_id") % 4).cast("string").alias("pool"), F.col("event_id").alias("seq"), F.get(names, (F.col("event_id") % 8).cast("int")).alias("model_a"), F.get(names, ((F.col("event_id") + 1 + F.col("user_id") % 7) % 8).cast("int")).alias("model_b"),
        F.when(F.col("value") > 55, "model_a").when(F.col("value") < 45, "model_b").otherwise("tie").alias("winner"),
    )
    out = live.run_once(live.online_ratings(battles, "pool"), "update")
    return out.groupBy("pool", "model").agg(F.max_by("rating", "batch").alias("rating"))
