"""Model sanity: shape, label range, better than the majority class, and our
metrics equal to MLlib's evaluator on the same predictions."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

import __spark_entry__ as E
from textlab.operators import evaluate as EV

from conftest import SF01


@pytest.fixture(scope="module")
def preds(spark):
    return E.queries()["features_fit_predict"](spark, SF01).cache()


def test_shape_and_label_range(preds):
    rows = preds.collect()
    assert len(rows) == 1000
    assert {r.pred for r in rows} <= {0, 1, 2, 3} and {r.y for r in rows} == {0, 1, 2, 3}


def test_better_than_majority(preds):
    test = preds.where(F.col("split") == "test")
    n = test.count()
    majority = test.groupBy("y").count().agg(F.max("count")).first()[0] / n
    acc = test.agg(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
    assert acc > majority


def test_metrics_equal_mllib(preds):
    test = preds.where(F.col("split") == "test").select(F.col("y").cast("double").alias("label"),
                                                        F.col("pred").cast("double").alias("prediction"), "y", "pred")
    ours = EV.summary(EV.pair_counts(test.withColumn("g", F.lit(1)), ["g"]), ["g"]).first()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    assert math.isclose(ours.accuracy, ev.setMetricName("accuracy").evaluate(test), rel_tol=1e-12)
    assert math.isclose(ours.f1_weighted, ev.setMetricName("f1").evaluate(test), rel_tol=1e-12)
    assert math.isclose(ours.precision_weighted, ev.setMetricName("weightedPrecision").evaluate(test), rel_tol=1e-12)


def test_pooled_head_runs(spark):
    p = E.queries()["clf_pooled_head"](spark, SF01)
    rows = p.collect()
    assert len(rows) == 500 and all(0 <= r.pred <= 9 for r in rows)


def test_hashed_tfidf_keeps_every_term(spark):
    """Widths beyond the vocabulary give sklearn's weights: no term is left out."""
    from pyspark.ml import Pipeline
    from textlab.operators import models as M
    docs = [["a", "b", "b", "rare"], ["a", "c"], ["a", "b", "d", "d", "d"]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, tokens array<string>")
    out = Pipeline(stages=M.hashed_tfidf("tokens", "x", 1 << 16)).fit(df).transform(df)
    vectors = {r.id: sorted(r.x.values.tolist()) for r in out.collect()}
    for i, d in enumerate(docs):
        w = [d.count(t) * (math.log(4 / (1 + sum(t in e for e in docs))) + 1) for t in set(d)]
        norm = math.sqrt(sum(x * x for x in w))
        assert vectors[i] == pytest.approx(sorted(x / norm for x in w))


@pytest.mark.parametrize("name", ["clf_mlp_meta", "param_runs"])
def test_other_models(spark, name):
    from conftest import SF001
    rows = E.queries()[name](spark, SF001).collect()
    if name == "param_runs":
        assert len(rows) == 4 and all(0.5 < r.accuracy <= 1 for r in rows)
    else:
        test = [r for r in rows if r.split == "test"]
        assert len(rows) == 200 and sum(r.y == r.pred for r in test) > 0.5 * len(test)
