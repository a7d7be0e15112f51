"""Registered queries: evaluation and epoch histories (2.8).

Predictions are derived from ``embeddings`` (vec_id = id, label = true class,
10 classes) for two runs x five epochs; scores are keyed uniforms plus a
signal 0.1 * epoch on the true class, so accuracy grows with the epoch.  The
same formula in DuckDB gives the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..functions.numeric import rround
from ..operators import evaluate as EV
from ..operators import labels as L
from ..sources.tables import read_table
from . import duck as D
from .registry import register

RUNS = ["run_a", "run_b"]
EPOCHS = [1, 2, 3, 4, 5]
K = 10
BATCH = 64
STEP_BATCH = 4
BY = ["run", "epoch", "split"]


def predictions(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    cells = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(ep).alias("epoch")) for r in RUNS for ep in EPOCHS])
    p = e.select("vec_id", "label", F.explode(cells).alias("c")).select("vec_id", "label", "c.run", "c.epoch")
    scores = F.transform(F.sequence(F.lit(0), F.lit(K - 1)),
                         lambda c: hash_uniform("score", F.col("run"), F.col("epoch"), F.col("vec_id"), c)
                         + F.when(c == F.col("label"), F.lit(0.1) * F.col("epoch")).otherwise(F.lit(0.0)))
    split = F.when(hash_uniform("split", F.col("vec_id")) < 0.8, "train").otherwise("val")
    p = p.select("run", F.col("run").alias("model"), "epoch", split.alias("split"), F.col("vec_id").alias("id"),
                 F.col("label").alias("y"), scores.alias("scores"))
    return p.withColumn("pred", EV.argmax_label("scores"))


_PRED_SQL = f"""p0 AS (
  SELECT r.run, r.run AS model, CAST(ep.epoch AS INTEGER) AS epoch,
         CASE WHEN {D.hash_uniform('split', 'vec_id')} < CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'val' END AS split,
         vec_id AS id, label AS y,
         list_transform(range({K}), lambda c: {D.hash_uniform('score', 'r.run', 'ep.epoch', 'vec_id', 'c')}
             + CASE WHEN c = label THEN CAST(0.1 AS DOUBLE) * ep.epoch ELSE 0.0 END) AS scores
  FROM embeddings, (VALUES {", ".join(f"('{r}')" for r in RUNS)}) r(run), range(1, {len(EPOCHS) + 1}) ep(epoch)),
p AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred FROM p0)"""


def _counts_sql(by=BY):
    b = ", ".join(by)
    on = " AND ".join(f"t.{c} = q.{c}" for c in by + ["class"])
    co = ", ".join(f"coalesce(t.{c}, q.{c}) AS {c}" for c in by)
    return f"""counts AS (SELECT {b}, y, pred, count(*) AS n FROM p GROUP BY {b}, y, pred),
t AS (SELECT {b}, y AS class, sum(n) AS support, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS tp FROM counts GROUP BY {b}, y),
q AS (SELECT {b}, pred AS class, sum(n) AS predicted FROM counts GROUP BY {b}, pred),
pc0 AS (SELECT {co}, coalesce(t.class, q.class) AS class, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support,
               coalesce(predicted, 0) AS predicted FROM t FULL OUTER JOIN q ON {on}),
pc1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc1),
sm AS (SELECT {b}, sum(support) AS n, sum(tp) / sum(support) AS accuracy, avg(precision) AS precision_macro,
              avg(recall) AS recall_macro, avg(f1) AS f1_macro,
              sum(precision * support) / sum(support) AS precision_weighted,
              sum(recall * support) / sum(support) AS recall_weighted,
              sum(f1 * support) / sum(support) AS f1_weighted FROM pc GROUP BY {b})"""


def _with(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def _counts(spark, sf_dir, by=BY):
    return EV.pair_counts(predictions(spark, sf_dir), by)


@register("argmax_label", _with(_PRED_SQL) + "SELECT run, epoch, split, id, y, pred FROM p")
def q_argmax_label(spark, sf_dir):
    return predictions(spark, sf_dir).select("run", "epoch", "split", "id", "y", "pred")


@register("argmax_onehot", _with(_PRED_SQL) + f"""
SELECT run, epoch, id, array_to_string(list_transform(range({K}), lambda i: CAST(i = pred AS INTEGER)), ',') AS onehot FROM p""")
def q_argmax_onehot(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("run", "epoch", "id", F.array_join(L.one_hot("pred", K), ",").alias("onehot"))


@register("accuracy", _with(_PRED_SQL) + """
SELECT run, epoch, split, round(avg(CAST(pred = y AS DOUBLE)), 6) AS accuracy FROM p GROUP BY run, epoch, split""")
def q_accuracy(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.groupBy(*BY).agg(rround(F.avg((F.col("pred") == F.col("y")).cast("double")), 6).alias("accuracy"))


@register("f1_weighted", _with(_PRED_SQL, _counts_sql()) + "SELECT run, epoch, split, round(f1_weighted, 6) AS f1_weighted FROM sm")
def q_f1_weighted(spark, sf_dir):
    s = EV.summary(_counts(spark, sf_dir), BY)
    return s.select(*BY, rround("f1_weighted", 6).alias("f1_weighted"))


@register("f1_macro", _with(_PRED_SQL, _counts_sql()) + "SELECT run, epoch, split, round(f1_macro, 6) AS f1_macro FROM sm")
def q_f1_macro(spark, sf_dir):
    s = EV.summary(_counts(spark, sf_dir), BY)
    return s.select(*BY, rround("f1_macro", 6).alias("f1_macro"))


_REPORT_SQL = """
SELECT run, epoch, split, CAST(class AS VARCHAR) AS row, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(CAST(support AS DOUBLE), 6) AS support FROM pc
UNION ALL SELECT run, epoch, split, 'macro avg', round(precision_macro, 6), round(recall_macro, 6), round(f1_macro, 6), round(CAST(n AS DOUBLE), 6) FROM sm
UNION ALL SELECT run, epoch, split, 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), round(CAST(n AS DOUBLE), 6) FROM sm
"""


def _rounded(df, cols=("precision", "recall", "f1", "support")):
    for c in cols:
        df = df.withColumn(c, rround(c, 6))
    return df


@register("class_report", _with(_PRED_SQL, _counts_sql()) + _REPORT_SQL + """
UNION ALL SELECT run, epoch, split, 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), round(accuracy, 6) FROM sm""")
def q_class_report(spark, sf_dir):
    return _rounded(EV.class_report(_counts(spark, sf_dir), BY))


@register("class_report_multilabel", _with(_PRED_SQL, _counts_sql()) + _REPORT_SQL + """
UNION ALL SELECT run, epoch, split, 'micro avg', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), round(CAST(n AS DOUBLE), 6) FROM sm
UNION ALL SELECT run, epoch, split, 'samples avg', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), round(CAST(n AS DOUBLE), 6) FROM sm""")
def q_class_report_multilabel(spark, sf_dir):
    return _rounded(EV.class_report(_counts(spark, sf_dir), BY, multilabel=True))


@register("report_no_support", _with(_PRED_SQL, _counts_sql()) + """
SELECT run, epoch, split, CAST(class AS VARCHAR) AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc
UNION ALL SELECT run, epoch, split, 'macro avg', round(precision_macro, 6), round(recall_macro, 6), round(f1_macro, 6) FROM sm
UNION ALL SELECT run, epoch, split, 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6) FROM sm""")
def q_report_no_support(spark, sf_dir):
    r = EV.class_report(_counts(spark, sf_dir), BY).where(F.col("row") != "accuracy").drop("support")
    return _rounded(r, ("precision", "recall", "f1"))


_CM_SQL = """cls AS (SELECT DISTINCT run, epoch, split, c FROM (SELECT run, epoch, split, y AS c FROM counts UNION ALL SELECT run, epoch, split, pred FROM counts) u),
cm AS (SELECT a.run, a.epoch, a.split, a.c AS y, b.c AS pred, CAST(coalesce(k.n, 0) AS BIGINT) AS n
       FROM cls a JOIN cls b ON a.run = b.run AND a.epoch = b.epoch AND a.split = b.split
       LEFT JOIN counts k ON k.run = a.run AND k.epoch = a.epoch AND k.split = a.split AND k.y = a.c AND k.pred = b.c)"""


def _cm(spark, sf_dir):
    return EV.confusion(_counts(spark, sf_dir), BY)


@register("confusion_raw", _with(_PRED_SQL, _counts_sql(), _CM_SQL) + "SELECT run, epoch, split, y, pred, n FROM cm")
def q_confusion_raw(spark, sf_dir):
    return _cm(spark, sf_dir).select(*BY, "y", "pred", "n")


@register("confusion_norm_pred", _with(_PRED_SQL, _counts_sql(), _CM_SQL) + """
SELECT run, epoch, split, y, pred, n, round_even(CASE WHEN sum(n) OVER (PARTITION BY run, epoch, split, pred) = 0 THEN 0.0
       ELSE n / sum(n) OVER (PARTITION BY run, epoch, split, pred) END * 1000000.0, 0) / 1000000.0 AS share FROM cm""")
def q_confusion_norm_pred(spark, sf_dir):
    return EV.confusion_norm_pred(_cm(spark, sf_dir), BY, digits=6).select(*BY, "y", "pred", "n", "share")


@register("confusion_rownorm_swapped", _with(_PRED_SQL, _counts_sql(), _CM_SQL) + """
SELECT run, epoch, split, pred, y, round_even(CASE WHEN sum(n) OVER (PARTITION BY run, epoch, split, pred) = 0 THEN 0.0
       ELSE n / sum(n) OVER (PARTITION BY run, epoch, split, pred) END * 100.0, 0) / 100.0 AS share FROM cm""")
def q_confusion_rownorm_swapped(spark, sf_dir):
    """The analysed code passes (pred, true): rows are predictions, each row
    normalised.  Same numbers as normalising by predicted column, 2 decimals,
    with the axes named correctly."""
    return EV.confusion_norm_pred(_cm(spark, sf_dir), BY, digits=2).select(*BY, "pred", "y", "share")


_XENT = "(list_max(scores) + ln(list_sum(list_transform(scores, lambda x: exp(x - list_max(scores))))) - scores[y + 1])"
_SIG = "list_transform(scores, lambda x: 1.0 / (1.0 + exp(-x)))"
_XENT_SIG = _XENT.replace("scores", "sg")


@register("cross_entropy", _with(_PRED_SQL) + f"""
SELECT run, epoch, split, round(avg({_XENT}), 6) AS loss, round(avg({_XENT_SIG}), 6) AS loss_sigmoid_first,
       round(avg(-ln(sg[y + 1] / list_sum(sg))), 6) AS loss_prob
FROM (SELECT *, {_SIG} AS sg FROM p) x GROUP BY run, epoch, split""")
def q_cross_entropy(spark, sf_dir):
    """Three modes: softmax cross-entropy of the scores, the same applied to
    sigmoid outputs, and probability cross-entropy -log(p_y / sum p) of the
    sigmoid outputs (the Keras recompiled loss)."""
    p = predictions(spark, sf_dir)
    sig = F.transform("scores", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
    return p.groupBy(*BY).agg(rround(F.avg(EV.softmax_xent("scores", "y")), 6).alias("loss"),
                              rround(F.avg(EV.softmax_xent("scores", "y", sigmoid_first=True)), 6).alias("loss_sigmoid_first"),
                              rround(F.avg(EV.prob_xent(sig, "y")), 6).alias("loss_prob"))


def _batches_sql(bsize):
    return f"""bl AS (SELECT run, epoch, split, (row_number() OVER (PARTITION BY run, epoch, split ORDER BY id) - 1) // {bsize} AS batch,
                {_XENT} AS l FROM p),
bm AS (SELECT run, epoch, split, batch, count(*) AS n, avg(l) AS loss FROM bl GROUP BY run, epoch, split, batch)"""


def _batches(spark, sf_dir, bsize):
    p = predictions(spark, sf_dir).withColumn("l", EV.softmax_xent("scores", "y"))
    return EV.batch_losses(p, BY, "id", "l", bsize)


@register("batch_mean_loss", _with(_PRED_SQL, _batches_sql(BATCH)) + """
SELECT run, epoch, split, round(avg(loss), 6) AS batch_mean_loss FROM bm GROUP BY run, epoch, split""")
def q_batch_mean_loss(spark, sf_dir):
    return _batches(spark, sf_dir, BATCH).groupBy(*BY).agg(rround(F.avg("loss"), 6).alias("batch_mean_loss"))


@register("running_loss", _with(_PRED_SQL, _batches_sql(STEP_BATCH)) + """
SELECT run, epoch, CAST(batch // 50 AS BIGINT) AS block, round(avg(loss), 6) AS loss, count(*) AS steps,
       CAST(count(*) = 50 AS INTEGER) AS complete
FROM bm WHERE split = 'train' GROUP BY run, epoch, batch // 50""")
def q_running_loss(spark, sf_dir):
    b = _batches(spark, sf_dir, STEP_BATCH).where(F.col("split") == "train")
    r = EV.running_loss(b, ["run", "epoch"], 50)
    return r.select("run", "epoch", "block", rround("loss", 6).alias("loss"), "steps", "complete")


def history(spark, sf_dir):
    """Epoch history (run, epoch, split, loss, acc, f1) from the predictions."""
    p = predictions(spark, sf_dir).withColumn("l", EV.softmax_xent("scores", "y"))
    loss = p.groupBy(*BY).agg(F.avg("l").alias("loss"))
    s = EV.summary(EV.pair_counts(p, BY), BY).select(*BY, F.col("accuracy").alias("acc"), F.col("f1_weighted").alias("f1"))
    return loss.join(s, BY)


_HIST_SQL = f"""ls AS (SELECT run, epoch, split, avg({_XENT}) AS loss FROM p GROUP BY run, epoch, split),
hist AS (SELECT ls.run, ls.epoch, ls.split, loss, accuracy AS acc, f1_weighted AS f1 FROM ls JOIN sm USING (run, epoch, split))"""


@register("epoch_metrics", _with(_PRED_SQL, _counts_sql(), _HIST_SQL) + """
SELECT run, epoch, split, round(loss, 6) AS loss, round(acc, 6) AS acc, round(f1, 6) AS f1 FROM hist""")
def q_epoch_metrics(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.select(*BY, *[rround(c, 6).alias(c) for c in ("loss", "acc", "f1")])


_LAST = max(EPOCHS)


@register("compare_models", _with(_PRED_SQL, _counts_sql()) + f"""
SELECT run AS model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted
FROM sm WHERE split = 'val' AND epoch = {_LAST}""")
def q_compare_models(spark, sf_dir):
    """All models scored on the same validation rows in one aggregation."""
    p = predictions(spark, sf_dir).where((F.col("split") == "val") & (F.col("epoch") == _LAST))
    s = EV.summary(EV.pair_counts(p, ["model"]), ["model"])
    return s.select("model", *[rround(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@register("rank_models", _with(_PRED_SQL, _counts_sql()) + f"""
SELECT run AS model, round(f1_weighted, 6) AS f1_weighted,
       CAST(row_number() OVER (ORDER BY f1_weighted DESC, run) AS BIGINT) AS rank
FROM sm WHERE split = 'val' AND epoch = {_LAST}""")
def q_rank_models(spark, sf_dir):
    from pyspark.sql import Window
    p = predictions(spark, sf_dir).where((F.col("split") == "val") & (F.col("epoch") == _LAST))
    s = EV.summary(EV.pair_counts(p, ["model"]), ["model"])
    w = Window.orderBy(F.desc("f1_weighted"), F.asc("model"))   # one row per model
    return s.select("model", rround("f1_weighted", 6).alias("f1_weighted"),
                    F.row_number().over(w).cast("long").alias("rank"))


@register("best_epoch", _with(_PRED_SQL, _counts_sql(), _HIST_SQL) + """
SELECT run, CAST(arg_max(epoch, (f1, -epoch)) AS INTEGER) AS best_epoch, round(max(f1), 6) AS best_f1
FROM hist WHERE split = 'val' GROUP BY run""")
def q_best_epoch(spark, sf_dir):
    h = history(spark, sf_dir).where(F.col("split") == "val")
    b = EV.best_epoch(h)
    return b.select("run", "best_epoch", rround("best_f1", 6).alias("best_f1"))


@register("max_accuracy", _with(_PRED_SQL, _counts_sql(), _HIST_SQL) + """
SELECT run, round(max(acc), 6) AS max_val_acc FROM hist WHERE split = 'val' GROUP BY run""")
def q_max_accuracy(spark, sf_dir):
    h = history(spark, sf_dir).where(F.col("split") == "val")
    return h.groupBy("run").agg(rround(F.max("acc"), 6).alias("max_val_acc"))


@register("epoch_delta", _with(_PRED_SQL, _counts_sql(), _HIST_SQL) + """
SELECT run, epoch, round(tr, 6) AS train, round(va, 6) AS val, round(tr - va, 6) AS gap,
       round(va - lag(va) OVER (PARTITION BY run ORDER BY epoch), 6) AS val_change
FROM (SELECT run, epoch, max(CASE WHEN split = 'train' THEN f1 END) AS tr, max(CASE WHEN split = 'val' THEN f1 END) AS va
      FROM hist GROUP BY run, epoch) w""")
def q_epoch_delta(spark, sf_dir):
    d = EV.epoch_delta(history(spark, sf_dir))
    return d.select("run", "epoch", *[rround(c, 6).alias(c) for c in ("train", "val", "gap", "val_change")])


@register("report_over_iterations", _with(_PRED_SQL, _counts_sql()) + """
SELECT run, CAST(class AS VARCHAR) AS row, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std,
       round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean
FROM pc WHERE split = 'val' GROUP BY run, class""")
def q_report_over_iterations(spark, sf_dir):
    """Per-iteration (epoch) reports gathered into mean / std per class."""
    r = EV.class_report(_counts(spark, sf_dir), BY).where(F.col("split") == "val") \
          .where(~F.col("row").isin("accuracy", "macro avg", "weighted avg"))
    return r.groupBy("run", "row").agg(rround(F.avg("f1"), 6).alias("f1_mean"), rround(F.stddev_samp("f1"), 6).alias("f1_std"),
                                       rround(F.avg("precision"), 6).alias("precision_mean"),
                                       rround(F.avg("recall"), 6).alias("recall_mean"))
