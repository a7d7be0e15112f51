"""Parquet table access for the given data directory.

Reads are lazy; Catalyst prunes columns and pushes filters into the parquet
scan, so a caller that selects two columns reads two columns.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``read_table`` for work that costs much per row (regexes, tokenising).

    A file of one row group is read by one task, however small the splits.  Where a
    table has fewer splits than the session has cores, its rows are dealt to all
    cores first; a table with more splits, as any large one, is read as it is."""
    df = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
