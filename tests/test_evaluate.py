"""Evaluation edge cases: never-predicted class, ties, sums, per-class metrics."""

import math


from textlab.operators import evaluate as EV

# y, pred - class 2 is never predicted, class 3 is never true
PAIRS = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 3), (2, 0), (2, 1)]


def _counts(spark):
    df = spark.createDataFrame([("r", y, p) for y, p in PAIRS], "run string, y int, pred int")
    return EV.pair_counts(df, ["run"])


def _py_report():
    classes = sorted({c for pair in PAIRS for c in pair})
    out = {}
    for c in classes:
        tp = sum(1 for y, p in PAIRS if y == c and p == c)
        sup = sum(1 for y, _ in PAIRS if y == c)
        pr = sum(1 for _, p in PAIRS if p == c)
        prec = tp / pr if pr else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[c] = (prec, rec, f1, sup)
    return out


def test_per_class_and_averages(spark):
    exp = _py_report()
    got = {r["class"]: r for r in EV.per_class(_counts(spark), ["run"]).collect()}
    for c, (p, r, f, s) in exp.items():
        assert math.isclose(got[c].precision, p) and math.isclose(got[c].recall, r)
        assert math.isclose(got[c].f1, f) and got[c].support == s
    s = EV.summary(_counts(spark), ["run"]).first()
    n = len(PAIRS)
    assert math.isclose(s.accuracy, sum(1 for y, p in PAIRS if y == p) / n)
    assert math.isclose(s.f1_macro, sum(v[2] for v in exp.values()) / len(exp))
    assert math.isclose(s.f1_weighted, sum(v[2] * v[3] for v in exp.values()) / n)


def test_class_report_rows(spark):
    rows = EV.class_report(_counts(spark), ["run"]).collect()
    names = [r.row for r in rows]
    assert set(names) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    acc = [r for r in rows if r.row == "accuracy"][0]
    assert acc.precision == acc.recall == acc.f1 == acc.support
    ml = {r.row for r in EV.class_report(_counts(spark), ["run"], multilabel=True).collect()}
    assert {"micro avg", "samples avg"} <= ml and "accuracy" not in ml


def test_confusion_sums_and_zero_fill(spark):
    cm = EV.confusion(_counts(spark), ["run"]).collect()
    assert len(cm) == 16 and sum(r.n for r in cm) == len(PAIRS)
    norm = EV.confusion_norm_pred(EV.confusion(_counts(spark), ["run"]), ["run"]).collect()
    for p in range(4):
        col = [r.share for r in norm if r.pred == p]
        assert math.isclose(sum(col), 1.0) or sum(col) == 0.0


def test_argmax_ties_first(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],), ([2.0, 1.0, 2.0],)], "s array<double>")
    assert [r[0] for r in df.select(EV.argmax_label("s")).collect()] == [1, 0]


def test_cross_entropy(spark):
    s = [1.0, 2.0, 0.5]
    df = spark.createDataFrame([(s, 1)], "s array<double>, y int")
    got = df.select(EV.softmax_xent("s", "y"), EV.softmax_xent("s", "y", sigmoid_first=True)).first()
    lse = math.log(sum(math.exp(x) for x in s))
    assert math.isclose(got[0], lse - s[1], rel_tol=1e-12)
    sg = [1 / (1 + math.exp(-x)) for x in s]
    assert math.isclose(got[1], math.log(sum(math.exp(x) for x in sg)) - sg[1], rel_tol=1e-12)
    assert got[1] > math.log(1 + 2 / math.e) - 1e-9   # floor of softmax over sigmoid outputs, 3 classes


def test_best_epoch_first_wins(spark):
    h = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.2)], "run string, epoch int, f1 double")
    got = {r.run: r.best_epoch for r in EV.best_epoch(h).collect()}
    assert got == {"a": 2, "b": 1}


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    from textlab.operators.profile import exact_percentiles
    rng = np.random.default_rng(1)
    rows = [("hot", 7.0) for _ in range(300)] + [("hot", float(x)) for x in rng.integers(0, 50, 200)]
    rows += [("one", 3.5)] + [("cont", float(x)) for x in rng.normal(size=257)]
    df = spark.createDataFrame(rows, "g string, v double")
    for accuracy in (30, 100, 20_000):
        got = {(r.g, r.p): r.q for r in exact_percentiles(df, "g", "v", [0.0, 0.25, 0.5, 0.9, 1.0], accuracy).collect()}
        for g in ("hot", "one", "cont"):
            vals = np.array([v for gg, v in rows if gg == g])
            for p in (0.0, 0.25, 0.5, 0.9, 1.0):
                assert math.isclose(got[(g, p)], float(np.percentile(vals, p * 100)), rel_tol=1e-12, abs_tol=1e-12)


def test_quartiles_of_all_columns_take_two_readings(spark, tmp_path):
    import numpy as np
    from textlab.operators.profile import describe_by_label, exact_quantiles
    rng = np.random.default_rng(3)
    rows = [(g, int(a), float(b) if a % 7 else None) for g in ("x", None) for a, b in zip(rng.integers(0, 30, 400), rng.normal(size=400))] + [("empty", None, None)]
    spark.createDataFrame(rows, "g string, a int, b double").repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    found = exact_quantiles(df, "g", ["a", "b"], [0.25, 0.5, 0.99], 50)
    got = {(r.g, r.col, r.p): r.q for r in found.collect()}
    for g in ("x", None):
        for i, c in ((1, "a"), (2, "b")):
            vals = [r[i] for r in rows if r[0] == g and r[i] is not None]
            for p in (0.25, 0.5, 0.99):
                assert math.isclose(got.pop((g, c, p)), float(np.percentile(vals, p * 100)), rel_tol=1e-12, abs_tol=1e-12)
    assert not got
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
    described = {r.g: r for r in describe_by_label(df, "g", ["a", "b"]).collect()}
    assert described["empty"].a_count == 0 and described["empty"].b_p50 is None and described["x"].a_p50 == np.percentile([r[1] for r in rows if r[0] == "x"], 50)


def test_prob_xent(spark):
    p = [0.2, 0.5, 0.3, 0.4]
    df = spark.createDataFrame([(p, 2)], "p array<double>, y int")
    got = df.select(EV.prob_xent("p", "y")).first()[0]
    assert math.isclose(got, -math.log(p[2] / sum(p)), rel_tol=1e-12)
