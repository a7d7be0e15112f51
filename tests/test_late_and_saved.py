"""Late materialisation, membership filters, saved token tables, run tables, label bounds."""

import re

import pytest
from pyspark.sql import functions as F

from textlab.operators import joins as J
from textlab.operators import labels as L
from textlab.operators import splits as S
from textlab.operators import vocab as V
from textlab.sources import files as FS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_vectors_keep_the_last_line_of_a_word(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("3 2\none 1 1\ntwo 2 2\none 3 3\n")
    b.write_text("two 9 9\nthree 4 5\n")
    out = FS.scan_wordvec(spark, str(tmp_path))
    assert {r.token: r.vec for r in out.collect()} == {"one": [3.0, 3.0], "two": [9.0, 9.0], "three": [4.0, 5.0]}
    assert "SortAggregate" not in plan(out)


def test_pool_first_fetches_one_vector_a_group(spark):
    rows = [("x", 3, [3.0]), ("x", 1, [1.0]), (None, 7, [7.0]), (None, 9, [9.0]), ("y", -2, None)]
    out = V.pool_first(spark.createDataFrame(rows, "g string, k int, v array<double>"), "g", "k", "v")
    assert {r.g: r.v for r in out.collect()} == {"x": [1.0], None: [7.0], "y": None}
    assert "SortAggregate" not in plan(out)


def test_a_repeated_run_replaces_its_own_partition(spark, tmp_path):
    path = str(tmp_path / "reports")
    first = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "run string, iteration int, f1 double")
    FS.sink_report(first, path)
    FS.sink_report(spark.createDataFrame([("a", 2, 0.9)], "run string, iteration int, f1 double"), path)
    got = {(r.run, r.iteration): r.f1 for r in FS.scan_report(spark, path, "f1 double, run string, iteration int").collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 0.9, ("b", 1): 0.7}


@pytest.mark.parametrize("most", [1 << 29, 1])
def test_anti_joins_with_and_without_the_filter(spark, monkeypatch, most):
    monkeypatch.setattr(J, "MOST_BITS", most)
    full = spark.createDataFrame([(i % 90, f"t{i % 90}" if i % 9 else None) for i in range(200)], "k int, t string").union(
        spark.createDataFrame([(None, None), (None, "t")], "k int, t string"))
    some = spark.createDataFrame([(i, f"t{i}" if i % 9 else None) for i in range(0, 90, 2)] + [(None, None)], "k int, t string")
    held = {tuple(r) for r in some.collect()}
    got = sorted((tuple(r) for r in J.anti_join_natural(full, some).collect()), key=str)
    assert got == sorted((tuple(r) for r in full.collect() if tuple(r) not in held), key=str)
    keys = {k for k, _ in held if k is not None}
    got = sorted((tuple(r) for r in J.anti_join_key(full, some, "k").collect()), key=str)
    assert got == sorted((tuple(r) for r in full.collect() if r.k not in keys), key=str)
    assert J.anti_join_key(full, some.limit(0), "k").count() == 202


def test_leaked_rows(spark):
    rows = [(1, "A  b", "train"), (2, "a b", "val"), (3, "c", "val"), (4, None, "val"), (5, None, "train")]
    got = S.leaked_rows(spark.createDataFrame(rows, "id int, text string, split string"), "id", "text", lambda c: F.regexp_replace(F.lower(c), " +", " "))
    assert [r.id for r in got.collect()] == [2]


def test_stratified_cuts_equal_ranks(spark):
    from textlab.operators import rank as R
    df = spark.range(700).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") > 20, (F.col("id") % 7).cast("string")).alias("lab"))
    got = {r.k: r.split for r in S.stratified_split(df, "k", "lab", 0.3, 5).collect()}
    ranked = R.with_count(R.hash_rank(df.fillna("none"), "k", 5, "r", partition_by=["lab"]), "n", partition_by=["lab"])
    want = {r.k: "test" if r.r <= -(-r.n * 3 // 10) else "train" for r in ranked.collect()}
    assert got == want


def test_saved_tokens_need_no_shuffle_by_document(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (4, None)], "doc long, tokens array<string>")
    path = FS.scratch_path(spark, "tokens")
    t = V.save_tokens(docs, "doc", "tokens", "tokens_" + re.sub(r"\W", "", path)[-20:], path, 3)
    vocab = V.vocab_of(t.where("token is not null"), "doc")
    assert {r.token: r.idx for r in vocab.collect()} == {"b": 1, "a": 2}
    tf, seq = V.saved_tf(t, "doc"), V.saved_sequences(t, "doc", vocab, 100)
    assert {(r.doc, r.term): r.tf for r in tf.collect()} == {(1, "b"): 2, (1, "a"): 1, (3, "a"): 1}
    assert {r.doc: r.seq for r in seq.collect()} == {1: [1, 2, 1], 2: [], 3: [2], 4: []}
    kept = V.saved_sequences(t, "doc", vocab, 2, "token", "kept")
    assert {r.doc: r.kept for r in kept.collect()} == {1: ["b", "b"], 2: [], 3: [], 4: []}
    for df in (tf, seq, kept, V.encode_fixed(seq, "seq", 4)):
        assert "hashpartitioning(doc" not in plan(df)


def test_too_many_classes_are_an_error(spark, monkeypatch):
    df = spark.range(5).select(F.col("id").cast("string").alias("l"))
    assert sorted(r.i for r in L.encode_label_alpha(df, "l", "i").collect()) == [0, 1, 2, 3, 4]
    monkeypatch.setattr(L, "MAX_CLASSES", 4)
    with pytest.raises(Exception, match="more than 4 labels"):
        L.encode_label_alpha(df, "l", "i").collect()


def test_all_cuts_of_a_split_come_from_one_plan(spark):
    out = S.kfold_contiguous(spark.range(57).withColumnRenamed("id", "k"), "k", 10)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("row_number()") <= 12 and out.select("fold").distinct().count() == 10
