"""Augmentation properties on 0-3 word texts and a longer text."""

from collections import Counter

from pyspark.sql import functions as F

from textlab.functions import text as TX
from textlab.operators import augment as A

TEXTS = ["", "one", "one two", "one two three", " ".join(f"w{i}" for i in range(40))]


def _df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string") \
                .withColumn("w", TX.tokenize_ws("text"))


def test_delete_is_subsequence(spark):
    rows = _df(spark).select("w", A.aug_delete(F.col("w"), F.col("id"), 1).alias("d")).collect()
    for r in rows:
        it = iter(r.w)
        assert all(x in it for x in r.d)
        if len(r.w) == 1:
            assert r.d == r.w


def test_swap_keeps_multiset(spark):
    rows = A.with_aug_swap(_df(spark), "w", "id", 3, "s").collect()
    for r in rows:
        assert Counter(r.s) == Counter(r.w)
        if len(r.w) >= 2:
            assert sum(a != b for a, b in zip(r.s, r.w)) == 2 or len(set(r.w)) < len(r.w)


def test_insert_adds_one(spark):
    rows = A.with_aug_insert(_df(spark), "w", "id", 5, "s").collect()
    for r in rows:
        assert len(r.s) == (len(r.w) + 1 if r.w else 0)
        if r.w:
            assert (Counter(r.s) - Counter(r.w)).total() == 1


def test_augment_text_one_word_unchanged(spark):
    rows = A.with_augment_text(_df(spark), "text", "id", 9, "a").collect()
    for r in rows:
        if len(r.text.split()) == 1:
            assert r.a == r.text


def test_augment_dataset_size(spark):
    df = spark.range(30).select(F.col("id"), F.lit("x").alias("label"), F.lit("a b c").alias("text"))
    out = A.augment_dataset(df, "id", "text", "label", 0.2)
    assert out.count() == 36
    assert out.where(F.col("variant") == "augmented").count() == 6


def test_lexicon_translate_keeps_unknown_and_order(spark):
    df = spark.createDataFrame([(1, "Hello big world"), (2, "")], "id long, text string")
    lex = spark.createDataFrame([("hello", "halo"), ("world", "dunia")], "src string, dst string")
    got = {r.id: r.translated for r in A.lexicon_translate(df, "id", "text", [lex]).collect()}
    assert got == {1: "halo big dunia", 2: ""}


def test_composed_legs_equal_sequential_legs(spark):
    df = spark.createDataFrame([(1, "Hello big World again"), (2, "Again and again")], "id long, text string")
    leg1 = spark.createDataFrame([("hello", "Halo"), ("world", "dunia")], "src string, dst string")
    leg2 = spark.createDataFrame([("halo", "hi"), ("again", "lagi"), ("dunia", "World")], "src string, dst string")
    leg3 = spark.createDataFrame([("world", "bumi"), ("big", "besar")], "src string, dst string")

    def seq(text):
        out = []
        for w in text.split():
            for leg in ({"hello": "Halo", "world": "dunia"}, {"halo": "hi", "again": "lagi", "dunia": "World"},
                        {"world": "bumi", "big": "besar"}):
                w = leg.get(w.lower(), w)
            out.append(w)
        return " ".join(out)

    got = {r.id: r.translated for r in A.lexicon_translate(df, "id", "text", [leg1, leg2, leg3]).collect()}
    assert got == {1: seq("Hello big World again"), 2: seq("Again and again")}
