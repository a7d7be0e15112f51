"""Hand-written cases for histograms, word clouds, validation, box plots, split cuts."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import labels as L
from textlab.operators import profile as P
from textlab.operators import rank as R
from textlab.operators import splits as S
from textlab.operators import vocab as V


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 1, 2, 100)] + [("b", 7.0), ("c", None)], "label string, x double")
    got = {(r.label, r.bin): r.n for r in P.hist_by_label(df, "label", "x").collect()}
    assert got == {**{("a", i): 0 for i in range(10)}, **{("b", i): 0 for i in range(10)}, ("a", 0): 3, ("a", 9): 1, ("b", 5): 1}


def test_punctuation_is_no_part_of_a_word(spark):
    df = spark.createDataFrame([("a", "good, good good! don't it's-it the")], "label string, text string")
    got = {r.word: r.n for r in P.top_words_by_label(df, "label", "text", ["the"]).collect()}
    assert got == {"good": 3, "don't": 1, "it's": 1, "it": 1}


def test_validation_reads_the_cleaned_text(spark):
    df = spark.createDataFrame([(1, "   ", "en"), (2, "the the", "en"), (3, None, "en"), (4, " the  good\tone ", " EN "), (5, "fine", "xx")], "id int, text string, lang string")
    got = [(r.id, r.text, r.lang, r.label_idx) for r in L.scan_validated(df, "text", "lang", {"en": 0}, ["the"]).collect()]
    assert got == [(4, "good one", "en", 0)]


def test_whiskers_and_outliers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 100, -50)], "g string, v double")
    r = P.grouped_boxplot(df, "g", "v").first()
    assert (r.vmin, r.whisker_lo, r.q1, r.median, r.q3, r.whisker_hi, r.vmax, r.n_outliers) == (-50, 1, 1.5, 3, 4.5, 5, 100, 2)
    assert sorted(x.v for x in P.boxplot_outliers(df, "g", "v").collect()) == [-50, 100]


@pytest.mark.parametrize("n", [0, 1, 7])
def test_cuts_on_small_tables(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    assert S.sample_frac(df, "k", 0.5).count() == round(0.5 * n)
    assert S.holdout_split(df, "k", 0.0).where("split = 'val'").count() == 0
    folds = sorted(r.fold for r in S.kfold_contiguous(df, "k", 3).collect())
    assert folds == sorted(i for i in range(3) for _ in range(n // 3 + (i < n % 3)))


def test_splits_move_no_payload(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 100).alias("payload"))
    out = S.split_ceil(df, "k", 0.2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0].split("scalar-subquery")[0]
    assert out.where("split = 'test'").count() == 10


def test_running_total_and_vocabulary_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i * 3, i) for i in range(500)], "k int, v int")
    got = {r.k: r.t for r in R.running_total(df, "k", "v", "t", descending=True, n_buckets=8).collect()}
    assert got == {i * 3: sum(range(i + 1, 500)) for i in range(500)}
    monkeypatch.setattr(V, "RANGE", 5)
    docs = spark.createDataFrame([(d, [f"w{(d * 7 + i * i) % 83}" for i in range(d % 9)]) for d in range(60)], "id long, tokens array<string>")
    counts, first = {}, {}
    for r in docs.orderBy("id").collect():
        for i, t in enumerate(r.tokens):
            counts[t] = counts.get(t, 0) + 1
            first.setdefault(t, (r.id, i))
    want = {t: i + 1 for i, t in enumerate(sorted(counts, key=lambda t: (-counts[t], first[t])))}
    assert {r.token: r.idx for r in V.build_vocab(docs, "id", "tokens").collect()} == want
