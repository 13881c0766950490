"""Live metrics over streams of requests, reviews and battles."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.session import shared_folder


def file_stream(spark: SparkSession, folder: str, table: str, max_files: int = 100) -> DataFrame:
    """A table's files as a stream, one file or a folder of them; ``max_files`` a batch bounds what is in flight."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{table}.parquet")
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def counters(requests: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total, low, high): running counters, for output mode complete or update."""
    return requests.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def _timed(rows: DataFrame, at: str) -> DataFrame:
    """Event time must have a zone: times without one are taken in the session's."""
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def windowed(events: DataFrame, at: str, key: str, value: str, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, key, n, total) by tumbling or sliding windows of event time; rows later than ``late`` are dropped, which
    bounds the state."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    g = _timed(events, at).withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(start, end, key, n): sessions of a key's events that follow each other within ``gap``."""
    g = _timed(events, at).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(rows: DataFrame, key: list[str], at: str | None = None, late: str = "2 days") -> DataFrame:
    """Each key's first row, as a cache that resumes must not work twice; with ``at`` the state is bounded by time."""
    return _timed(rows, at).withWatermark(at, late).dropDuplicatesWithinWatermark(key) if at else rows.dropDuplicates(key)


def online_ratings(battles: DataFrame, pool: str, k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """(pool, model, rating): ratings that move with each battle (pool, seq, model_a, model_b, winner), in the order of
    ``seq`` within a batch; a pool's ratings are its state. Each batch gives the new ratings of the pools it touched."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings: dict[str, float] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for a, b, winner in zip(rows["model_a"], rows["model_b"], rows["winner"], strict=True):
            ra, rb = ratings.get(a, start), ratings.get(b, start)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            got = {"model_a": 1.0, "model_b": 0.0}.get(winner, 0.5)
            ratings[a], ratings[b] = ra + k * (got - expected), rb - k * (got - expected)
        state.update((json.dumps(ratings),))
        yield pd.DataFrame({"pool": key[0], "model": list(ratings), "rating": list(ratings.values())})

    return battles.groupBy(pool).applyInPandasWithState(step, "pool string, model string, rating double", "ratings string", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "complete", on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table; the progress lies in the shared folder, so a run that
    was cut short goes on where it stopped.

    ``complete`` keeps the last batch, ``append`` and ``update`` all of them with their ``batch``.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{base}/out")
        else:
            # a batch that is tried again replaces what it wrote before
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        if on_batch:
            on_batch(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    kind = T.StructType([*stream.schema.fields, *([] if mode == "complete" else [T.StructField("batch", T.IntegerType())])])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # there was no batch
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(f"{base}/out")
