"""Session construction and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_written: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "tallyloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the engine expects. ``master`` only where no launcher sets it."""
    builder = SparkSession.builder.appName(app).config(map=_SETTINGS | settings)
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves in local mode, and a cluster is refused: a
    machine-local folder would lose data with its machine.
    """
    if folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later joins a known size, so that Spark broadcasts
    it only where it is small. The files go with release(), or when the session's Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes what durable() wrote so far; for long sessions, once the results that read it are stored or collected."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


atexit.register(release)
