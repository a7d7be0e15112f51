"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.sources.files import scratch_path
from textlab.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the graded classifier does not reject."""
    from textlab.llm import quality
    labels = read_table(spark, sf_dir, "labels")
    model = quality.fit_rows(quality.graded_rows(docs, labels))
    return quality.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat, up to a few edits, an earlier line."""
    from textlab.llm import line_dedup
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    from textlab.llm import simhash
    return simhash.keep_single(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret found masked."""
    from textlab.llm import secret_scan
    path = scratch_path(spark, "blob-ledger")
    secret_scan.update_ledger(docs, path, first=True)
    return secret_scan.redact_blobs(docs, path).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed."""
    from textlab.llm import packing
    from textlab.llm.queries import tokenizer_path
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: Several stages (trained scores, edit distances, tokens) have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
