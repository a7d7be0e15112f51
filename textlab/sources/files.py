"""File sources and sinks: CSV, word-vector text, per-run report partitions.

Scratch output goes below the session's reliable checkpoint directory (on a
cluster the shared folder named by ``spark.checkpoint.dir``), never to a
machine-local temporary folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import labels as L
from ..session import ensure_checkpoint_dir

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint directory (one per call)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/textlab-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a fresh folder and read again: computed once, and
    kept when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """Write CSV without an index column; fields with quotes / newlines are quoted."""
    (df.write.mode(mode).option("header", str(header).lower()).option("quote", '"')
       .option("escape", '"').csv(path))
    return path


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with an explicit schema; multi-line quoted fields as pandas reads them.
    (multiLine files are not split inside a file; the writer produces many files.)"""
    r = spark.read.options(**{**CSV_OPTIONS, "header": str(header).lower()})
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def scan_drop_cols(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop stray columns (a leaked index, ``ReachSize``); missing ones are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def load_labelled(spark: SparkSession, path: str, names: Sequence[str], label_map: Mapping[str, int],
                  label: str = "label", drop: Sequence[str] = ()) -> DataFrame:
    """CSV -> positional names -> strict label index (an unknown label fails the job)."""
    df = scan_csv(spark, path)
    df = scan_drop_cols(df, drop)
    df = rename_positional(df, names)
    return L.map_label(df, label, label_map, out="label_idx", strict=True)


def sink_wordvec(df: DataFrame, token: str, vec: str, path: str) -> str:
    """Word-vector text format: a line 'count dim', then 'token f1 .. fD'.

    The body is written distributed (one part file per partition); the count
    line is a one-row aggregate appended as its own part file, since readers
    recognise it by content - no global sort to put it first.
    """
    body = df.select(F.concat_ws(" ", F.col(token), F.array_join(F.transform(vec, lambda x: x.cast("string")), " "))
                     .alias("value"))
    body.write.mode("overwrite").text(path)
    head = df.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size(F.col(vec))).cast("string"))
                  .alias("value"))
    head.write.mode("append").text(path)
    return path


def scan_wordvec(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(token, vec array<float>) from word-vector text (plain or .gz).

    The count line is recognised by content (exactly two fields), not by
    position.  A duplicated word keeps its last occurrence, by (file, position in
    file): the place is one decimal number, so a hash aggregate over (word, place)
    finds it, and only then are the vectors of those lines fetched.
    """
    raw = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("__f"), F.monotonically_increasing_id().alias("__pos"))
    files = raw.select("__f").distinct().select("__f", F.row_number().over(Window.orderBy("__f")).alias("__no"))  # one row a file
    parts = F.split(F.trim(F.col("value")), " ")
    rows = raw.select(parts.alias("p"), "__f", "__pos").where(F.size("p") > 2)
    if dim is not None:
        rows = rows.where(F.size("p") == dim + 1)
    place = (F.col("__no").cast("decimal(10,0)") * F.lit(str(1 << 63)).cast("decimal(20,0)") + F.col("__pos")).cast("decimal(38,0)")
    rows = rows.join(files, "__f").select(F.col("p")[0].alias("token"), F.col("p"), place.alias("__at"))
    last = rows.groupBy(F.col("token").alias("__t")).agg(F.max("__at").alias("__last"))
    kept = rows.join(last, (F.col("token") == F.col("__t")) & (F.col("__at") == F.col("__last")), "left_semi")
    return kept.select("token", F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def sink_report(df: DataFrame, path: str, partition_by: Sequence[str] = ("run", "iteration")) -> str:
    """Per-run / per-iteration report tables, partitioned so later reads prune.

    Writing again replaces the partitions that ``df`` has rows for and leaves all
    others: a run that is repeated takes its own place and no other's."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
       .option("header", "true").csv(path))
    return path


def scan_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read partitioned report CSVs back; partition columns come from the paths."""
    return spark.read.option("header", "true").schema(schema).csv(path)
