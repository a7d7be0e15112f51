"""Training logs and printed classification reports: write as text, parse back.

Logs are one file per run (``partitionBy(run)``), read with ``wholetext`` so a
three-line epoch block is matched by one regular expression; parsing is
``regexp_extract_all`` per group, ``arrays_zip`` and ``inline`` - all JVM-side.
A report is parsed line by line with a row pattern, so it does not depend on
fixed line offsets (reports with and without an accuracy row both work).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# FIXED VALUES: the three-line epoch block of the analysed training logs
LOG_BLOCK = (r"Epoch\s+(\d+)/\d+\s+Train Loss:\s+([\d.]+)\s+\|\s+Acc:\s+([\d.]+)\s+\|\s+F1:\s+([\d.]+)"
             r"\s+Val\s+Loss:\s+([\d.]+)\s+\|\s+Acc:\s+([\d.]+)\s+\|\s+F1:\s+([\d.]+)")
LOG_FIELDS = ["epoch", "train_loss", "train_acc", "train_f1", "val_loss", "val_acc", "val_f1"]

# a report row: name, precision, recall, f1, support
REPORT_ROW = r"^\s*(.+?)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+)\s*$"
REPORT_ACCURACY = r"^\s*(accuracy)\s+(\d+\.\d+)\s+(\d+)\s*$"


def format_train_log(history: DataFrame, run: str = "run") -> DataFrame:
    """(run, log) text per run from a wide history (run, epoch, train_loss,
    train_acc, train_f1, val_loss, val_acc, val_f1).  One run's blocks are
    collected per run - bounded by its epoch count, not by the data."""
    n = F.max("epoch").over(Window.partitionBy(run))
    block = F.format_string("Epoch %d/%d\n  Train Loss: %.4f | Acc: %.4f | F1: %.4f\n  Val   Loss: %.4f | Acc: %.4f | F1: %.4f\n",
                            F.col("epoch"), n, *[F.col(c) for c in LOG_FIELDS[1:]])
    b = history.select(run, "epoch", block.alias("block"))
    coll = b.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("epoch", "block"))).alias("__b"))
    return coll.select(run, F.array_join(F.transform("__b", lambda x: x["block"]), "").alias("log"))


def sink_train_logs(logs: DataFrame, path: str, run: str = "run") -> str:
    logs.select(run, F.col("log").alias("value")).write.mode("overwrite").partitionBy(run).text(path)
    return path


def parse_train_log(df: DataFrame, text: str = "value", keep=("run",)) -> DataFrame:
    """Rows (keep..., epoch, train_loss, train_acc, train_f1, val_loss, val_acc, val_f1)."""
    arrays = [F.regexp_extract_all(F.col(text), F.lit(LOG_BLOCK), i + 1).alias(f) for i, f in enumerate(LOG_FIELDS)]
    z = df.select(*keep, F.arrays_zip(*arrays).alias("z"))
    rows = z.select(*keep, F.inline("z"))
    return rows.select(*keep, F.col("epoch").cast("int").alias("epoch"),
                       *[F.col(f).cast("double").alias(f) for f in LOG_FIELDS[1:]])


def scan_train_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file (wholetext) with the ``run`` partition column."""
    return parse_train_log(spark.read.text(path, wholetext=True))


def format_report_text(report: DataFrame, by, digits: int = 4) -> DataFrame:
    """sklearn-style printed report per group from report rows
    (by..., row, precision, recall, f1, support)."""
    by = list(by)
    fmt = f"%12s %9.{digits}f %9.{digits}f %9.{digits}f %9d"
    line = F.when(F.col("row") == "accuracy",
                  F.format_string(f"%12s %9s %9s %9.{digits}f %9d", F.col("row"), F.lit(""), F.lit(""), F.col("f1"),
                                  F.col("__n"))) \
            .otherwise(F.format_string(fmt, F.col("row"), F.col("precision"), F.col("recall"), F.col("f1"),
                                       F.col("support").cast("long")))
    # order: classes, blank, accuracy, macro avg, weighted avg
    order = F.when(F.col("row") == "accuracy", 2).when(F.col("row") == "macro avg", 3) \
             .when(F.col("row") == "weighted avg", 4).otherwise(1)
    n = F.max(F.when(F.col("row") == "weighted avg", F.col("support"))).over(Window.partitionBy(*by)).cast("long")
    r = report.withColumn("__n", n).select(*by, order.alias("__o"), F.col("row"), line.alias("line"))
    coll = r.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__o", "row", "line"))).alias("__l"))
    header = F.lit(" " * 12 + "  precision    recall  f1-score   support\n\n")
    body = F.array_join(F.transform("__l", lambda x: F.concat(
        F.when(x["__o"] == 2, F.lit("\n")).otherwise(F.lit("")), x["line"])), "\n")
    return coll.select(*by, F.concat(header, body, F.lit("\n")).alias("report"))


def parse_report_text(df: DataFrame, text: str = "report", keep=()) -> DataFrame:
    """Printed report -> (keep..., line_no, row, precision, recall, f1, support).

    Class and average rows match the five-field pattern; the accuracy row
    (two numbers) gets precision and recall null.  Blank and header lines
    match neither and are dropped.
    """
    keep = list(keep)
    lines = df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    row = F.regexp_extract("line", REPORT_ROW, 1)
    acc = F.regexp_extract("line", REPORT_ACCURACY, 1)
    out = lines.select(
        *keep, F.col("line_no").cast("long").alias("line_no"),
        F.when(row != "", row).otherwise(acc).alias("row"),
        F.when(row != "", F.regexp_extract("line", REPORT_ROW, 2).cast("double")).alias("precision"),
        F.when(row != "", F.regexp_extract("line", REPORT_ROW, 3).cast("double")).alias("recall"),
        F.when(row != "", F.regexp_extract("line", REPORT_ROW, 4).cast("double"))
         .otherwise(F.regexp_extract("line", REPORT_ACCURACY, 2).cast("double")).alias("f1"),
        F.when(row != "", F.regexp_extract("line", REPORT_ROW, 5).cast("long"))
         .otherwise(F.regexp_extract("line", REPORT_ACCURACY, 3).cast("long")).alias("support"))
    return out.where(F.col("row") != "")
