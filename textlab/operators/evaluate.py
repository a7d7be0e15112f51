"""Evaluation from a predictions table (run, model, epoch, split, id, y, scores).

Every metric derives from one aggregate: counts per (group, y, pred).  That
table has at most groups x classes^2 rows, so reports, averages and confusion
matrices are computed on it, never by scanning predictions per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rround
from . import rank as R


def argmax_label(scores) -> Column:
    """0-based index of the largest score; the first one on ties."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def softmax_xent(scores, y, sigmoid_first: bool = False) -> Column:
    """-log softmax(scores)[y], max-shifted (log-sum-exp).  ``sigmoid_first``
    reproduces cross-entropy applied to sigmoid outputs."""
    s = F.col(scores) if isinstance(scores, str) else scores
    if sigmoid_first:
        s = F.transform(s, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
    m = F.array_max(s)
    lse = m + F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    yy = F.col(y) if isinstance(y, str) else y
    return lse - F.element_at(s, yy + 1)


def prob_xent(probs, y) -> Column:
    """-log(p_y / sum p): cross-entropy of probability outputs."""
    p = F.col(probs) if isinstance(probs, str) else probs
    yy = F.col(y) if isinstance(y, str) else y
    return -F.log(F.element_at(p, yy + 1) / F.aggregate(p, F.lit(0.0), lambda a, x: a + x))


def pair_counts(pred: DataFrame, by: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    return pred.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, by: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    """(by, class, tp, support, predicted, precision, recall, f1) over the union
    of true and predicted labels; 0/0 gives 0 (sklearn zero_division=0)."""
    by = list(by)
    none = F.lit(0).cast("long")
    sides = F.array(  # each count speaks for its true class and for its predicted class
        F.struct(F.col(y).alias("class"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(none).alias("tp"),
                 F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col(p).alias("class"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")))
    j = (counts.select(*by, F.explode(sides).alias("c")).select(*by, "c.*")
         .groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]))
    prec = F.when(F.col("predicted") == 0, 0.0).otherwise(F.col("tp") / F.col("predicted"))
    rec = F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support"))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0) \
          .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return j.withColumn("f1", f1)


def summary(counts: DataFrame, by: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    """(by, n, accuracy, f1_macro, f1_weighted, precision/recall macro+weighted)."""
    by = list(by)
    pc = per_class(counts, by, y, p)
    return pc.groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def class_report(counts: DataFrame, by: Sequence[str], names: dict[int, str] | None = None,
                 multilabel: bool = False, y: str = "y", p: str = "pred") -> DataFrame:
    """sklearn classification_report as rows (by, row, precision, recall, f1, support).

    Class rows, then 'accuracy' (value repeated in all four columns, as the
    transposed report table shows it), 'macro avg', 'weighted avg'.  With
    ``multilabel`` (one-hot input) 'micro avg' and 'samples avg' replace
    'accuracy'; for one-hot rows both equal accuracy with support n.
    """
    by = list(by)
    pc = per_class(counts, by, y, p)
    name = F.col("class").cast("string")
    if names:
        m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
        name = F.coalesce(m[F.col("class")], name)
    rows = pc.select(*by, name.alias("row"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    s = summary(counts, by, y, p)
    acc = F.col("accuracy")
    extra = [
        s.select(*by, F.lit("macro avg").alias("row"), F.col("precision_macro").alias("precision"),
                 F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1"), F.col("n").cast("double").alias("support")),
        s.select(*by, F.lit("weighted avg").alias("row"), F.col("precision_weighted").alias("precision"),
                 F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1"),
                 F.col("n").cast("double").alias("support")),
    ]
    if multilabel:
        for label in ("micro avg", "samples avg"):
            extra.append(s.select(*by, F.lit(label).alias("row"), acc.alias("precision"), acc.alias("recall"),
                                  acc.alias("f1"), F.col("n").cast("double").alias("support")))
    else:
        extra.append(s.select(*by, F.lit("accuracy").alias("row"), acc.alias("precision"), acc.alias("recall"),
                              acc.alias("f1"), acc.alias("support")))
    out = rows
    for e in extra:
        out = out.unionByName(e)
    return out


def confusion(counts: DataFrame, by: Sequence[str], y: str = "y", p: str = "pred") -> DataFrame:
    """(by, y, pred, n) for every pair of known classes, zeros filled.

    The class grid comes from exploding the per-group class set (bounded by
    the number of classes) twice - no cross join of tables.
    """
    by = list(by)
    classes = counts.select(*by, F.explode(F.array(F.col(y), F.col(p))).alias("c")) \
                    .groupBy(*by).agg(F.array_sort(F.collect_set("c")).alias("__cs"))
    grid = classes.select(*by, F.explode("__cs").alias(y), "__cs").select(*by, y, F.explode("__cs").alias(p))
    return grid.join(counts, [*by, y, p], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def round_like_numpy(x: Column, digits: int) -> Column:
    """numpy ``round(a, d)`` (see ``functions.numeric``)."""
    return rround(x, digits)


def confusion_norm_pred(cm: DataFrame, by: Sequence[str], y: str = "y", p: str = "pred",
                        digits: int | None = None) -> DataFrame:
    """Each cell divided by its predicted-column total (0 when the column is
    empty), optionally rounded as numpy rounds (the analysed code rounds the
    normalised matrix with numpy)."""
    tot = F.sum("n").over(Window.partitionBy(*by, p))
    v = F.when(tot == 0, F.lit(0.0)).otherwise(F.col("n") / tot)
    return cm.withColumn("share", round_like_numpy(v, digits) if digits is not None else v)


def batch_losses(pred: DataFrame, by: Sequence[str], key: str, loss: str, batch_size: int) -> DataFrame:
    """(by, batch, n, loss) mean loss per minibatch of ``batch_size`` rows in
    key order within each group; ranks are bucketed, not one task per group."""
    kb = R.with_quantile_bucket(pred, key, "__kb", n_buckets=1024)
    r = R._ranked(kb, F.col("__kb"), [F.col(key)], "__r", partition_by=list(by)).drop("__kb")
    r = r.withColumn("batch", F.floor((F.col("__r") - 1) / batch_size).cast("long"))
    return r.groupBy(*by, "batch").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def running_loss(batches: DataFrame, by: Sequence[str], block: int = 50) -> DataFrame:
    """Mean batch loss over each block of ``block`` steps; the last, partial
    block is kept and flagged ``complete = 0``."""
    b = batches.withColumn("block", F.floor(F.col("batch") / block).cast("long"))
    return b.groupBy(*by, "block").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("steps")) \
            .withColumn("complete", (F.col("steps") == block).cast("int"))


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "f1") -> DataFrame:
    """Epoch with the highest metric per run; the earliest wins ties (strict >)."""
    return history.groupBy(run).agg(
        F.max_by(F.struct(F.col(epoch).alias("best_epoch"), F.col(metric).alias(f"best_{metric}")),
                 F.struct(F.col(metric), -F.col(epoch))).alias("b")).select(run, "b.*")


def epoch_delta(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "f1") -> DataFrame:
    """Train and val curves side by side per epoch, their gap and the change
    of the val metric since the previous epoch (window per run: one row per
    epoch)."""
    wide = history.groupBy(run, epoch).pivot("split", ["train", "val"]).agg(F.first(metric))
    w = Window.partitionBy(run).orderBy(epoch)
    return wide.withColumn("gap", F.col("train") - F.col("val")) \
               .withColumn("val_change", F.col("val") - F.lag("val").over(w))
