"""Anti joins with nulls / duplicates, label maps, file round trips, log parsing."""

import pytest

from pyspark.sql import functions as F

from textlab.operators import joins as J
from textlab.operators import labels as L
from textlab.sources import files as FS
from textlab.sources import logs as LG


def test_anti_join_natural_nulls_and_duplicates(spark):
    full = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "y"), ("c", "z")], "t string, l string")
    sample = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "t string, l string")
    got = sorted(tuple(r) for r in J.anti_join_natural(full, sample).collect())
    assert got == [("b", "y"), ("c", "z")]


def test_map_label_unknown_null_and_strict(spark):
    df = spark.createDataFrame([("love",), ("joy",), (None,)], "label string")
    got = [r.label_idx for r in L.map_label(df, "label", {"love": 0}).collect()]
    assert got == [0, None, None]
    with pytest.raises(Exception):
        L.map_label(df, "label", {"love": 0}, strict=True).collect()


def test_encode_alpha_and_detect_base(spark):
    df = spark.createDataFrame([("sadness",), ("anger",), ("joy",)], "label string")
    assert [r.label_idx for r in L.encode_label_alpha(df, "label").collect()] == [2, 0, 1]
    names = spark.createDataFrame([("IndoBERTweet_best.pt",), ("indobert-base.pt",), ("x.pt",)], "n string")
    got = [r[0] for r in names.select(L.detect_base_model("n")).collect()]
    assert got[0].endswith("indobertweet-base-uncased") and got[1] == got[2]


def test_csv_round_trip_multiline(spark):
    df = spark.createDataFrame([(1, 'he said "hi",\nthen left'), (2, "")], "id long, text string")
    path = FS.sink_csv(df, FS.scratch_path(spark, "t"))
    back = {r.id: r.text for r in FS.scan_csv(spark, path, "id long, text string").collect()}
    assert back[1] == 'he said "hi",\nthen left'


def test_wordvec_last_duplicate_wins(spark):
    path = FS.scratch_path(spark, "wv")
    spark.createDataFrame([("3 2",), ("a 1.0 2.0",), ("b 3.0 4.0",), ("a 5.0 6.0",)], "value string") \
         .coalesce(1).write.text(path)
    got = {r.token: list(r.vec) for r in FS.scan_wordvec(spark, path).collect()}
    assert got == {"a": [5.0, 6.0], "b": [3.0, 4.0]}


REPORT = """              precision    recall  f1-score   support

       anger     0.5000    0.4000    0.4444        10
        fear     1.0000    0.5000    0.6667         4

    accuracy                         0.5000        14
   macro avg     0.7500    0.4500    0.5556        14
weighted avg     0.6429    0.4286    0.5079        14
"""


def test_parse_report_with_and_without_accuracy(spark):
    no_acc = "\n".join(line for line in REPORT.split("\n") if "accuracy" not in line)
    df = spark.createDataFrame([(1, REPORT), (2, no_acc)], "rid int, report string")
    rows = LG.parse_report_text(df, "report", keep=["rid"]).collect()
    r1 = {r.row: r for r in rows if r.rid == 1}
    r2 = {r.row for r in rows if r.rid == 2}
    assert set(r1) == {"anger", "fear", "accuracy", "macro avg", "weighted avg"}
    assert r1["accuracy"].f1 == 0.5 and r1["accuracy"].precision is None and r1["fear"].support == 4
    assert r2 == {"anger", "fear", "macro avg", "weighted avg"}


def test_parse_train_log(spark):
    log = ("Epoch 1/2\n  Train Loss: 1.5888 | Acc: 0.2764 | F1: 0.1743\n  Val   Loss: 1.5704 | Acc: 0.4052 | F1: 0.2859\n"
           "Epoch 2/2\n  Train Loss: 1.5255 | Acc: 0.4727 | F1: 0.3759\n  Val   Loss: 1.4757 | Acc: 0.5335 | F1: 0.4415\n")
    df = spark.createDataFrame([("r", log)], "run string, value string")
    rows = LG.parse_train_log(df).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [1, 2] and rows[1].val_f1 == 0.4415 and rows[0].train_loss == 1.5888


def test_safe_map_text_and_scan_validated(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "  ", "x"), (3, "hi", None), (4, "hi", "halo")],
                               "id long, text string, mapped string")
    got = {r.id: r.m for r in df.select("id", L.safe_map_text("text", "mapped").alias("m")).collect()}
    assert got == {1: "", 2: "", 3: "hi", 4: "halo"}
    raw = spark.createDataFrame([(1, " Love ", "a"), (2, "joy", "b"), (3, "anger", None), (4, "ANGER", "")],
                                "id long, label string, text string")
    rows = L.scan_validated(raw, "text", "label", {"love": 0, "anger": 1}).collect()
    assert [(r.id, r.label, r.label_idx) for r in sorted(rows, key=lambda r: r.id)] == [(1, "love", 0)]


def test_bt_diversity_and_histogram(spark):
    from textlab.operators import augment as A
    from textlab.operators import profile as P
    df = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("a b", "a b c")], "o string, b string")
    jac, ch = A.bt_diversity(F.col("o"), F.col("b"))
    got = [(round(r[0], 6), round(r[1], 6)) for r in df.select(jac, ch).collect()]
    assert got == [(0.5, round(1 / 3, 6)), (1.0, 0.0), (round(2 / 3, 6), round(1 / 3, 6))]
    h = spark.createDataFrame([("k", 5), ("k", 5), ("m", 0), ("m", 10), ("m", 10)], "g string, x int")
    rows = {(r.g, r.bin): r.n for r in P.hist_by_label(h, "g", "x").collect()}
    # every group has all ten bins; constant group: [x-.5, x+.5]; last bin closed
    assert rows == {(g, b): {("k", 5): 2, ("m", 0): 1, ("m", 9): 2}.get((g, b), 0) for g in "km" for b in range(10)}
