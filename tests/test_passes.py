"""Fits in passes over sparse rows give MLlib's models; nothing is kept dense or cached."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textlab.operators import models as M
from textlab.operators import trees as TR

WIDTH = 40


@pytest.fixture(scope="module")
def rows(spark):
    """Sparse rows of three classes with columns that tell them apart, some dense rows and a row of zeros."""
    rng, made = np.random.default_rng(5), []
    for i in range(400):
        y = int(rng.integers(3))
        value = np.where(rng.random(WIDTH) < 0.15, rng.random(WIDTH), 0.0)
        value[y * 3:y * 3 + 3] += rng.random(3) * (rng.random(3) < 0.6)
        at = np.flatnonzero(value)
        made.append((i, float(y), Vectors.dense(value) if i % 5 == 0 else Vectors.sparse(WIDTH, at.tolist(), value[at].tolist())))
    made[7] = (7, made[7][1], Vectors.sparse(WIDTH, [], []))
    return spark.createDataFrame(made, ["doc_id", "label", "features"]).repartition(3).cache()


def _predictions(model, rows):
    return {r.doc_id: r.prediction for r in model.transform(rows).select("doc_id", "prediction").collect()}


def test_boosted_trees_are_mllibs(rows):
    own = M.ovr_gbt(max_iter=6).fit(rows)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=6, maxDepth=3, seed=42)
    theirs = OneVsRest(classifier=gbt, featuresCol="features", labelCol="label").fit(rows)
    for c, model in enumerate(theirs.models):
        first = model.trees[0].toDebugString.split("(feature ")[1].split(" <= ")
        assert own.forest.column[0, c, 0] == int(first[0])
        assert own.forest.cut[0, c, 0] == pytest.approx(float(first[1].split(")")[0]))
    assert _predictions(own, rows) == _predictions(theirs, rows)


def test_rows_without_a_label_are_of_no_class(rows):
    some = rows.withColumn("label", F.when(F.col("doc_id") % 7 > 0, F.col("label")))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=2, maxDepth=3, seed=42)
    theirs = OneVsRest(classifier=gbt, featuresCol="features", labelCol="label").fit(some)
    assert _predictions(M.ovr_gbt(max_iter=2).fit(some), some) == _predictions(theirs, some)


def test_histograms_hold_no_dense_row(rows, monkeypatch):
    """What a fit stores is as large as the entries that are not 0, and nothing is cached."""
    def cached():
        return rows.sparkSession.sparkContext._jsc.sc().getPersistentRDDs().size()

    kept, keep, before = [], TR.stored, (rows.count(), cached())[1]
    monkeypatch.setattr(TR, "stored", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    M.ovr_gbt(max_iter=1).fit(rows)
    codes = kept[0].agg(F.sum(F.length("code"))).first()[0]
    assert codes == 4 * sum(int(np.count_nonzero(r.features.toArray())) for r in rows.collect())
    assert cached() <= before


def test_thresholds_of_many_values():
    cuts = TR.thresholds(np.arange(1, 1001) / 1000.0, 2000.0, 32)
    assert len(cuts) <= 32 and (np.diff(cuts) > 0).all() and cuts[0] == pytest.approx(0.0005)
    assert TR.thresholds(np.array([2.0, 2.0, 4.0]), 3.0, 32).tolist() == [3.0]


@pytest.mark.parametrize("max_iter", [2, 25])
def test_perceptron_is_mllibs(rows, max_iter):
    own = M.mlp(WIDTH, [6, 5], 3, max_iter=max_iter).fit(rows)
    theirs = MultilayerPerceptronClassifier(layers=[WIDTH, 6, 5, 3], maxIter=max_iter, seed=42, blockSize=128).fit(rows)
    assert own.weights == pytest.approx(theirs.weights.toArray(), rel=1e-4, abs=1e-4)
    assert _predictions(own, rows) == _predictions(theirs, rows)
