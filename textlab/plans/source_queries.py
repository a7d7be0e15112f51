"""Registered queries: file sources and sinks, log and report parsing.

Each query writes data derived from the given tables to a fresh folder below
the checkpoint directory and reads it back through the operator under test,
so the oracle compares the round trip with the source table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numeric import rround
from ..operators import evaluate as EV
from ..sources import files as FS
from ..sources import logs as LG
from ..sources.tables import read_table
from . import eval_queries as EQ
from .registry import register

DOC_SCHEMA = "doc_id LONG, lang STRING, text STRING"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _written_docs(spark, sf_dir, header=True, extra_index=False):
    d = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    if extra_index:
        d = d.select(F.col("doc_id").alias("Unnamed: 0"), "doc_id", "lang", "text")
    path = FS.scratch_path(spark, "csv")
    FS.sink_csv(d, path, header=header)
    return path


@register("scan_csv", "SELECT doc_id, lang, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def q_scan_csv(spark, sf_dir):
    """Quoted multi-line texts survive the CSV round trip byte for byte."""
    df = FS.scan_csv(spark, _written_docs(spark, sf_dir), DOC_SCHEMA)
    return df.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@register("sink_csv", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def q_sink_csv(spark, sf_dir):
    df = FS.scan_csv(spark, _written_docs(spark, sf_dir), DOC_SCHEMA)
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("scan_drop_cols", "SELECT doc_id, lang FROM documents")
def q_scan_drop_cols(spark, sf_dir):
    """A leaked index column is dropped; a missing optional column is ignored."""
    df = FS.scan_csv(spark, _written_docs(spark, sf_dir, extra_index=True),
                     "`Unnamed: 0` LONG, doc_id LONG, lang STRING, text STRING")
    return FS.scan_drop_cols(df, ["Unnamed: 0", "ReachSize"]).select("doc_id", "lang")


@register("rename_positional", "SELECT doc_id AS id, lang AS label, md5(text) AS tweet_md5 FROM documents")
def q_rename_positional(spark, sf_dir):
    df = FS.scan_csv(spark, _written_docs(spark, sf_dir, header=False), header=False)
    df = FS.rename_positional(df, ["id", "label", "tweet"])
    return df.select(F.col("id").cast("long").alias("id"), "label", F.md5("tweet").alias("tweet_md5"))


_ALL_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.TEST_LANG_LABELS_ALL.items()) + " END"


@register("load_labelled", f"SELECT doc_id AS id, lang AS label, CAST({_ALL_CASE} AS BIGINT) AS label_idx FROM documents")
def q_load_labelled(spark, sf_dir):
    """CSV -> positional names -> strict label map (unknown label = job error)."""
    df = FS.load_labelled(spark, _written_docs(spark, sf_dir), ["id", "label", "tweet"], K.TEST_LANG_LABELS_ALL)
    return df.select(F.col("id").cast("long").alias("id"), "label", F.col("label_idx").cast("long").alias("label_idx"))


@register("scan_wordvec", """
SELECT 'w' || CAST(vec_id AS VARCHAR) AS token, CAST(len(embedding) AS BIGINT) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS vec_sum
FROM embeddings""")
def q_scan_wordvec(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("token"),
                                                        "embedding")
    path = FS.sink_wordvec(e, "token", "embedding", FS.scratch_path(spark, "wordvec"))
    v = FS.scan_wordvec(spark, path)
    return v.select("token", F.size("vec").cast("long").alias("dim"),
                    rround(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vec_sum"))


@register("sink_report", EQ._with(EQ._PRED_SQL, EQ._counts_sql()) + """
SELECT run, CAST(epoch AS INTEGER) AS iteration, split, CAST(class AS VARCHAR) AS row,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(CAST(support AS DOUBLE), 6) AS support FROM pc""")
def q_sink_report(spark, sf_dir):
    """Per-class reports written partitioned by (run, iteration) and read back."""
    rep = EV.class_report(EQ._counts(spark, sf_dir), EQ.BY).where(~F.col("row").isin("accuracy", "macro avg", "weighted avg"))
    rep = rep.withColumnRenamed("epoch", "iteration")
    path = FS.sink_report(EQ._rounded(rep), FS.scratch_path(spark, "report"))
    back = FS.scan_report(spark, path, "split STRING, row STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support DOUBLE")
    return back.select("run", F.col("iteration").cast("int").alias("iteration"), "split", "row",
                       "precision", "recall", "f1", "support")


@register("parse_train_log", EQ._with(EQ._PRED_SQL, EQ._counts_sql(), EQ._HIST_SQL) + """
SELECT run, epoch,
  round(max(CASE WHEN split = 'train' THEN loss END), 4) AS train_loss, round(max(CASE WHEN split = 'train' THEN acc END), 4) AS train_acc,
  round(max(CASE WHEN split = 'train' THEN f1 END), 4) AS train_f1, round(max(CASE WHEN split = 'val' THEN loss END), 4) AS val_loss,
  round(max(CASE WHEN split = 'val' THEN acc END), 4) AS val_acc, round(max(CASE WHEN split = 'val' THEN f1 END), 4) AS val_f1
FROM hist GROUP BY run, epoch""")
def q_parse_train_log(spark, sf_dir):
    """Epoch history -> three-line log blocks, one file per run -> parsed back."""
    h = EQ.history(spark, sf_dir)
    wide = h.groupBy("run", "epoch").agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
                                           for s in ("train", "val") for m in ("loss", "acc", "f1")])
    path = LG.sink_train_logs(LG.format_train_log(wide), FS.scratch_path(spark, "logs"))
    return LG.scan_train_logs(spark, path).select("run", "epoch", *LG.LOG_FIELDS[1:])


@register("parse_report_text", EQ._with(EQ._PRED_SQL, EQ._counts_sql()) + """
SELECT run, CAST(epoch AS INTEGER) AS epoch, split, CAST(class AS VARCHAR) AS row, round(precision, 4) AS precision,
       round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT run, epoch, split, 'macro avg', round(precision_macro, 4), round(recall_macro, 4), round(f1_macro, 4), CAST(n AS BIGINT) FROM sm
UNION ALL SELECT run, epoch, split, 'weighted avg', round(precision_weighted, 4), round(recall_weighted, 4), round(f1_weighted, 4), CAST(n AS BIGINT) FROM sm
UNION ALL SELECT run, epoch, split, 'accuracy', NULL, NULL, round(accuracy, 4), CAST(n AS BIGINT) FROM sm""")
def q_parse_report_text(spark, sf_dir):
    """Reports printed as text (one file per run / epoch / split) and parsed back."""
    rep = EV.class_report(EQ._counts(spark, sf_dir), EQ.BY)
    text = LG.format_report_text(rep, EQ.BY)
    path = FS.scratch_path(spark, "reports")
    text.select(*EQ.BY, F.col("report").alias("value")).write.mode("overwrite").partitionBy(*EQ.BY).text(path)
    back = spark.read.text(path, wholetext=True)
    p = LG.parse_report_text(back, "value", keep=EQ.BY)
    return p.select("run", F.col("epoch").cast("int").alias("epoch"), "split", "row", "precision", "recall", "f1", "support")
