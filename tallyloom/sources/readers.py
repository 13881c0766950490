"""Readers of evaluation data: JSON lines, JSON arrays, CSV, TSV, concatenated JSON, report folders, retrieval triples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """One object a line. Lines that don't parse are dropped, or kept whole in ``_corrupt``."""
    if keep_corrupt:
        fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema) if schema else None
        reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT)
        return (reader.schema(T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])) if fields else reader).json(path)
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """With a header; every column is a string, as nothing else is sure."""
    return spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def read_json_array(spark: SparkSession, path: str, field: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that is one array of objects, or an object with the array in ``field``. A file is read as a whole, so big
    data should come as JSON lines."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.inline(field)) if field else df


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects one after another in a text, with or without line ends, over several lines, also with literal ``\\n``
    between them.

    A file is decoded as one stream, object by object; where none can be decoded, reading goes on at the next brace. A
    file is read as a whole, so big data should come as JSON lines.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for b in batches:
            found = []
            for t in b.column(0).to_pylist():
                at = t.find("{")
                while at >= 0:
                    try:
                        _, end = decoder.raw_decode(t, at)
                        found.append(t[at:end])
                    except json.JSONDecodeError:
                        end = at + 1
                    at = t.find("{", end)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["j"])

    pieces = spark.read.text(path, wholetext=True).mapInArrow(split, "j string")
    return pieces.select(F.from_json("j", schema).alias("x")).select("x.*")


def read_subset(spark: SparkSession, folder: str, subset: str, split: str | None = None) -> DataFrame:
    """The first of ``{subset}_{split}`` and ``{subset}`` with the ending jsonl, csv or tsv that is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    readers = {"jsonl": read_jsonl, "csv": read_csv, "tsv": read_tsv}
    for ending, read in readers.items():
        for name in [*([f"{subset}_{split}"] if split else []), subset]:
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{ending}")
            if path.getFileSystem(conf).exists(path):
                return read(spark, f"{folder}/{name}.{ending}")
    raise FileNotFoundError(f"no data of {subset} in {folder}")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Every report below a folder, with its ``run_dir`` (the folder above ``reports``) from the path; files that are no
    report, collection reports and checkpoints are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "DROPMALFORMED").json(folder)
    path = F.col("_metadata.file_path")
    need = [c for c in ("model_name", "dataset_name", "score") if c in df.columns]
    if len(need) < 3:
        return spark.createDataFrame([], "model_name string, dataset_name string, score double, run_dir string, report_path string")
    known = df.filter("model_name is not null and dataset_name is not null").filter(~path.contains("/.ipynb_checkpoints/") & ~path.endswith("collection_report.json"))
    return known.select("*", F.regexp_extract(path, r"([^/]+)/reports/", 1).alias("run_dir"), path.alias("report_path"))


def read_retrieval(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a retrieval task: two JSON-lines files of (_id, text) and a TSV of relevances."""
    texts = "_id string, text string"
    qrels = read_tsv(spark, f"{folder}/qrels/test.tsv").select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("id"), F.col("score").cast("int").alias("score"))
    return read_jsonl(spark, f"{folder}/corpus.jsonl", texts), read_jsonl(spark, f"{folder}/queries.jsonl", texts), qrels


def read_prompts(spark: SparkSession, path: str, least: int = 0, most: int = 131072, column: str = "value") -> DataFrame:
    """Load-test prompts, one a line, of a length between two bounds."""
    n = F.char_length(column)
    return spark.read.text(path).filter((n >= least) & (n <= most)).select(F.col(column).alias("prompt"))


def random_prompts(spark: SparkSession, count: int, words: int, vocabulary: list[str], seed: int = 1) -> DataFrame:
    """``count`` prompts of ``words`` words drawn by seeded hashes, the same on every run."""
    bag = F.array(*map(F.lit, vocabulary))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.get(bag, F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(len(vocabulary))).cast("int")))
    return spark.range(count).select("id", F.array_join(drawn, " ").alias("prompt"))
