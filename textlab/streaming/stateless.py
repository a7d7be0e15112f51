"""Structured Streaming use of the stateless operators.

Cleaning, the scalar text features and scoring with a fitted PipelineModel
are per-row column expressions, so the same code runs on a streaming
DataFrame.  Sinks are fault tolerant: the query checkpoint lives below the
session's checkpoint directory (a shared folder on a cluster), and the file
sink commits each micro-batch atomically, so a restarted query resumes
without duplicates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources.files import scratch_path


def read_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                glob: str | None = None) -> DataFrame:
    """Parquet file stream over a directory (optionally only files matching ``glob``)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def clean_features(df: DataFrame, key: str, text: str, stopwords: Iterable[str]) -> DataFrame:
    """Stateless: cleaned text plus the eight meta features per row."""
    return df.select(key, TX.clean_text(text).alias("clean"), *TX.meta_feature_columns(text, stopwords))


def score(df: DataFrame, model) -> DataFrame:
    """Apply a fitted (stateless) PipelineModel to a stream."""
    return model.transform(df)


def run_available_now(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available now into a parquet sink, then stop."""
    q = (df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def stream_to_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run a streaming DataFrame to completion and return the sink as a table."""
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    run_available_now(df, out, ck)
    return spark.read.parquet(out)


def documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, one file or a folder of files, read as a file stream."""
    table = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(table).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    # a stream's path is a folder: a table of one file is found in the folder it lies in
    rows = read_stream(spark, table, schema) if folder else read_stream(spark, sf_dir, schema, glob="documents.parquet")
    return rows.select(F.col("doc_id"), F.col("text"), F.col("lang"))
