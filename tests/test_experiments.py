"""Repeated fits against plain ones: folds, bootstrap rounds, styles, learning curves."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as Q
from textlab.operators import evaluate as EV
from textlab.operators import experiments as E
from textlab.operators import models as M
from textlab.operators import splits as S

from conftest import SF001

WORDS = [["sun", "day", "warm"], ["rain", "wet", "cold", "day"], ["snow", "cold", "white"]]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(i % 3), i % 4, [str(w) for w in rng.choice(WORDS[i % 3], rng.integers(0, 7))] + [f"w{rng.integers(40)}"]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, tokens array<string>")
    return E.hashed_counts(df, "tokens", 256).cache()


def test_fold_idf_is_a_subtraction(table):
    idf = E.fold_idf(E.document_frequencies(table, "fold"))
    for fold, got in idf.items():
        model = M.SmoothIdf(inputCol="tf", outputCol="x").fit(table.where(F.col("fold") != fold))
        assert got == pytest.approx(model.getScalingVec().toArray())


def test_cross_validation_equals_plain_fits(table):
    lr = M.logreg(max_iter=15)
    grid = M.param_runs(lr, {lr.regParam: [0.0, 0.1]})
    found = Counter({(r.setting, r.fold, r.y, r.pred): r.n for r in E.cross_validate(table, lr, grid).collect()})
    for s, setting in enumerate(grid):
        for fold in (0, 3):
            train, test = table.where(F.col("fold") != fold), table.where(F.col("fold") == fold)
            chain = Pipeline(stages=[M.SmoothIdf(inputCol="tf", outputCol="w"), M.Normalizer(p=2.0, inputCol="w", outputCol="features"), lr.copy(setting)])
            want = Counter((s, fold, int(r.label), int(r.prediction)) for r in chain.fit(train).transform(test).collect())
            assert {k: n for k, n in found.items() if k[:2] == (s, fold)} == want
    assert sum(found.values()) == 2 * 240


def test_fold_counts(table):
    got = {(r.fold, r.label): (r.n_test, r.n_train) for r in E.fold_counts(table, "label", 5).collect()}
    rows = [(i % 4, float(i % 3)) for i in range(240)]
    assert got == {(f, c): (rows.count((f, c)), sum(x[1] == c for x in rows) - rows.count((f, c))) for f in range(5) for c in (0.0, 1.0, 2.0)}


def test_draws_are_sparse_and_complete(spark):
    df = spark.range(150).withColumnRenamed("id", "k")
    draws = {(r.round, r.k): r.times_drawn for r in S.bootstrap_draws(df, "k", rounds=3, seed0=5).collect()}
    every = {(r.round, r.k): r.times_drawn for r in S.bootstrap_oob(df, "k", rounds=3, seed0=5).collect()}
    assert draws == {x: n for x, n in every.items() if n} and len(every) == 450
    assert Counter(r for r, _ in draws).keys() == {5, 6, 7} and all(sum(n for (q, _), n in draws.items() if q == r) == 150 for r in (5, 6, 7))
    fewer = S.bootstrap_draws(df, "k", rounds=2, n_draws=40).collect()
    assert sum(r.times_drawn for r in fewer) == 80 and S.bootstrap_draws(df.limit(0), "k").count() == 0


def test_bootstrap_fits_equal_fits_on_copied_rows(spark, table):
    draws = S.bootstrap_draws(table, "id", rounds=3)
    held = E.stored(E.with_draws(table.select("id", "label", "tf"), draws, "id"), "t")
    lr = M.logreg(max_iter=15)
    found = {}
    for r in E.bootstrap_fits(held, lr, range(3)).collect():
        found.setdefault(r.round, Counter())[r.y, r.pred] = r.n
    for r in range(3):
        copied = table.join(draws.where(F.col("round") == r), "id").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("times_drawn"))))
        chain = Pipeline(stages=[M.SmoothIdf(inputCol="tf", outputCol="w"), M.Normalizer(p=2.0, inputCol="w", outputCol="features"), lr])
        model = chain.fit(copied)
        unseen = table.join(draws.where(F.col("round") == r), "id", "left_anti")
        want = Counter((int(x.label), int(x.prediction)) for x in model.transform(unseen).collect())
        assert sum(found[r].values()) == sum(want.values())
        assert sum((found[r] & want).values()) >= 0.97 * sum(want.values())  # the optimiser's sums differ in their last bits


def test_style_fits_equal_mllibs_evaluator(table):
    rows = table.withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train")).withColumn(
        "variant", F.when((F.col("id") % 5 == 0) | (F.col("id") % 2 == 0), "original").otherwise("edited"))
    styles, lr = {"natural": ("original",), "edited": ("original", "edited")}, M.logreg(max_iter=15)
    got = {r.style: r for r in EV.summary(E.style_fits(rows, lr, styles), ["style"]).collect()}
    for style, names in styles.items():
        train = rows.where((F.col("split") == "train") & F.col("variant").isin(*names))
        chain = Pipeline(stages=[M.SmoothIdf(inputCol="tf", outputCol="w"), M.Normalizer(p=2.0, inputCol="w", outputCol="features"), lr])
        scored = chain.fit(train).transform(rows.where(F.col("split") == "val"))
        ev = MulticlassClassificationEvaluator(labelCol="label")
        assert math.isclose(got[style].accuracy, ev.setMetricName("accuracy").evaluate(scored))
        assert math.isclose(got[style].f1_weighted, ev.setMetricName("f1").evaluate(scored))


def test_nested_prefixes(spark):
    n = 500
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    cells = {"a": F.col("g") < 5, "b": F.lit(True), "few": F.col("k") < 12, "none": F.col("k") < 0}
    got = {(r.cell, r["rank"]): r.k for r in E.nested_prefixes(df, "k", cells, 40, "s").collect()}
    inside = {"a": lambda k: k % 7 < 5, "b": lambda k: True, "few": lambda k: k < 12, "none": lambda k: False}
    want = {}
    for c, has in inside.items():
        order = sorted((hashlib.md5(f"s:{c}:{k}".encode()).hexdigest(), f"{c}:{k}", k) for k in range(n) if has(k))
        want |= {(c, i): k for i, (_, _, k) in enumerate(order[:40], 1)}
    assert got == want


def test_prefix_models_are_naive_bayes(spark):
    rng = np.random.default_rng(2)
    width, rows = 30, []
    for i in range(90):
        idx = np.unique(rng.integers(0, width, rng.integers(1, 8)))
        rows.append((int(rng.integers(3)), idx, rng.integers(1, 5, len(idx)).astype(float)))
    rank = rng.permutation(90) + 1
    made = dict(E.PrefixModels(3, width).fit(rank, np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows], [30, 60, 90, 200]))
    for size in (30, 60, 90, 200):
        df = spark.createDataFrame([(float(y), Vectors.sparse(width, i.tolist(), v.tolist())) for (y, i, v), r in zip(rows, rank) if r <= size], ["label", "features"])
        model = NaiveBayes(smoothing=1.0).fit(df)
        assert made[size][:width].T == pytest.approx(model.theta.toArray(), rel=1e-5)
        assert made[size][width] == pytest.approx(model.pi.toArray(), rel=1e-5)


@pytest.mark.parametrize("model_bytes", [64 << 20, 1])
def test_learning_curve_counts(spark, table, monkeypatch, model_bytes):
    monkeypatch.setattr(E, "MODEL_BYTES", model_bytes)
    rows = [(r.id, int(r.label), r.tf) for r in table.collect()]
    flat = spark.createDataFrame([(k, y, [int(i) for i in x.indices], [float(v) for v in x.values]) for k, y, x in rows], "id long, label int, idx array<int>, val array<double>")
    tests = {f"c{i}": (F.col("id") % 5 != i, F.col("id") % 5 == i) for i in range(3)}
    got = {(r.cell, r.size, r.y, r.pred): r.n for r in E.learning_curve(E.stored(flat, "t"), "id", tests, [20, 100, 999], 3, 256).collect()}
    want = Counter()
    for i in range(3):
        order = sorted((hashlib.md5(f"grid:c{i}:{k}".encode()).hexdigest(), k) for k, _, _ in rows if k % 5 != i)
        rank = {k: r for r, (_, k) in enumerate(order, 1)}
        train = [(rank[k], y, x) for k, y, x in rows if k in rank]
        models = dict(E.PrefixModels(3, 256).fit(np.array([t[0] for t in train]), np.array([t[1] for t in train]), [t[2].indices for t in train],
                                                 [t[2].values for t in train], [20, 100, 999]))
        for size, w in models.items():
            for k, y, x in rows:
                if k % 5 == i:
                    want[f"c{i}", size, y, int((w[x.indices].astype(float) * x.values[:, None]).sum(0).__add__(w[256]).argmax())] += 1
    assert got == want


def test_sparse_counts_keep_every_row(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None)]
    got = {r.id: r for r in E.sparse_counts(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", 1 << 20).collect()}
    assert sorted(got[1].val) == [1.0, 2.0] and got[1].idx == sorted(got[1].idx) and got[2].idx == [] and got[3].val == []


@pytest.mark.parametrize("name, by, rounds", [("cv_experiment", ("setting", "fold"), 20), ("bootstrap_report", ("round",), 10)])
def test_reports(spark, name, by, rounds):
    rows = Q.queries()[name](spark, SF001).collect()
    groups = {tuple(r[b] for b in by) for r in rows}
    assert len(groups) == rounds
    for g in groups:
        mine = {r["row"]: r for r in rows if tuple(r[b] for b in by) == g}
        classes = [r for k, r in mine.items() if k.isdigit()]
        assert sum(r.support for r in classes) == mine["weighted avg"].support and 0 <= mine["accuracy"].f1 <= 1
    assert np.mean([r.f1 for r in rows if r["row"] == "accuracy"]) > 0.5


def test_style_experiment(spark):
    rows = {r.style: r for r in Q.queries()["style_experiment"](spark, SF001).collect()}
    assert rows.keys() == {"natural", "augment", "1pBT", "2pBT"}
    assert all(r.n == 40 and r.accuracy > 0.5 for r in rows.values())


def test_learning_curve_query(spark):
    rows = Q.queries()["learning_curve"](spark, SF001).collect()
    accuracy = {(r.split_no, r.iteration, r.size): r.f1 for r in rows if r["row"] == "accuracy"}
    assert len(accuracy) == 5 * 10 * 13 and np.mean(list(accuracy.values())) > 0.5
    assert {r.support for r in rows if r["row"] == "weighted avg"} == {40.0}


@pytest.mark.parametrize("name", ["clf_tfidf_boost", "clf_meta_boost", "clf_lsa_boost", "clf_mlp_text"])
def test_classifiers_beat_the_majority(spark, name):
    rows = [r for r in Q.queries()[name](spark, SF001).collect() if r.split == "test"]
    most = Counter(r.y for r in rows).most_common(1)[0][1]
    assert len(rows) == 40 and sum(r.y == r.pred for r in rows) >= most


def test_run_table(spark):
    rows = Q.queries()["run_time"](spark, SF001).collect()
    assert sorted(r.run_id for r in rows) == [0, 1, 2, 3] and all(r.seconds > 0 and r.n_scored == 40 for r in rows)
