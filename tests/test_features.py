"""TF-IDF, scaling and LSA against direct computations on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from textlab.operators import features as FE

DOCS = ["the cat sat", "the dog sat down", "a cat and a dog", "zebra"]


def _docs(spark):
    df = spark.createDataFrame([(i, d.split()) for i, d in enumerate(DOCS)], "id long, tokens array<string>")
    return df


def _py_tfidf():
    n = len(DOCS)
    toks = [d.split() for d in DOCS]
    vocab = sorted({t for d in toks for t in d})
    df = {t: sum(1 for d in toks if t in d) for t in vocab}
    out = {}
    for i, d in enumerate(toks):
        w = {t: d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for t in set(d)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            out[(i, t)] = v / norm
    return out


def test_tfidf_long_form(spark):
    exp = _py_tfidf()
    got = {(r.id, r.term): r.weight for r in FE.tfidf(_docs(spark), "id", "tokens").collect()}
    assert got.keys() == exp.keys()
    assert all(math.isclose(got[k], exp[k], rel_tol=1e-12) for k in exp)
    norms = FE.tfidf(_docs(spark), "id", "tokens").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in norms)


def test_tfidf_vectors_equal_long_form(spark):
    vec, vocab = FE.tfidf_vectors(_docs(spark), "id", "tokens", k=100)
    long = {(r.id, r.term): r.weight for r in FE.tfidf(_docs(spark), "id", "tokens").collect()}
    for r in vec.collect():
        arr = r.tfidf.toArray()
        for j, t in enumerate(vocab):
            assert math.isclose(arr[j], long.get((r.id, t), 0.0), abs_tol=1e-12)


def test_scaling_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, 5.0, 4.0), (3, 5.0, 9.0)], "id long, c double, x double")
    z = FE.standard_scale(df, ["c", "x"]).orderBy("id").collect()
    assert [r.c_z for r in z] == [0.0, 0.0, 0.0]
    xs = np.array([2.0, 4.0, 9.0])
    assert np.allclose([r.x_z for r in z], (xs - xs.mean()) / xs.std())
    mm = FE.minmax_scale(df, ["c", "x"]).orderBy("id").collect()
    assert [r.c_mm for r in mm] == [0.0, 0.0, 0.0] and np.allclose([r.x_mm for r in mm], [0.0, 2 / 7, 1.0])


def test_lsa_matches_numpy_svd(spark):
    rng = np.random.default_rng(0)
    X = rng.random((30, 8)) * (rng.random((30, 8)) < 0.6)
    X[4] = 0
    rows = [(i, "kept", np.flatnonzero(x).astype(int).tolist(), x[x != 0].tolist()) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, other string, idx array<int>, val array<double>")
    out, s = FE.lsa(df, "id", 3)
    sv = np.linalg.svd(X, compute_uv=False)[:3]
    assert np.allclose(s, sv, rtol=1e-6) and out.columns == ["id", "other", "lsa"]
    us = np.array([r.lsa for r in out.orderBy("id").collect()])
    assert np.allclose(np.abs(us), np.abs(np.linalg.svd(X)[0][:, :3] * sv), rtol=1e-5, atol=1e-8)
    # directions of some rows only, all rows projected on them
    out, s = FE.lsa(df, "id", 3, fit_on=F.col("id") < 20)
    _, sv, vt = np.linalg.svd(X[:20])
    us = np.array([r.lsa for r in out.orderBy("id").collect()])
    assert np.allclose(s, sv[:3], rtol=1e-6) and np.allclose(np.abs(us), np.abs(X @ vt[:3].T), rtol=1e-5, atol=1e-8)
    assert FE.lsa(df.limit(0), "id", 3)[0].count() == 0


def test_tfidf_rows_equal_the_vectors(spark):
    docs = _docs(spark).unionByName(spark.createDataFrame([(9, []), (10, ["unseen"])], "id long, tokens array<string>"))
    for fit_on in (None, docs.where("id < 3")):
        vec, _ = FE.tfidf_vectors(docs, "id", "tokens", 4, fit_on=fit_on)
        want = {r.id: r.tfidf.toArray().tolist() for r in vec.collect()}
        for r in FE.tfidf_rows(docs, "id", "tokens", 4, fit_on=fit_on).collect():
            got = [0.0] * len(want[r.id])
            for i, v in zip(r.idx, r.val):
                got[i] = v
            assert np.allclose(got, want.pop(r.id))
        assert not want


def test_padding_edges(spark):
    from textlab.operators import vocab as V
    df = spark.createDataFrame([(1, [5, 6, 7, 8]), (2, [5, 6, 7]), (3, [5]), (4, [])], "id long, seq array<long>")
    pre = {r.id: r.padded for r in V.pad_pre(df, "seq", maxlen=3).collect()}
    assert pre == {1: [6, 7, 8], 2: [5, 6, 7], 3: [0, 0, 5], 4: [0, 0, 0]}
    auto = {r.id: r.padded for r in V.pad_pre(df, "seq").collect()}
    assert auto[3] == [0, 0, 0, 5] and auto[1] == [5, 6, 7, 8]
    fx = {r.id: (r.input_ids, r.attention_mask) for r in V.encode_fixed(df, "seq", 3).collect()}
    assert fx[1] == ([5, 6, 7], [1, 1, 1]) and fx[3] == ([5, 0, 0], [1, 0, 0]) and fx[4] == ([0, 0, 0], [0, 0, 0])


def test_vocab_rank_ties_first_appearance(spark):
    from textlab.operators import vocab as V
    docs = spark.createDataFrame([(0, ["b", "a", "c"]), (1, ["a", "c", "d", "b"]), (2, ["d"])], "id long, t array<string>")
    got = {r.token: (r.n, r.idx) for r in V.build_vocab(docs, "id", "t").collect()}
    # counts: a2 b2 c2 d2 -> all tied, first appearance b(0,0) a(0,1) c(0,2) d(1,2)
    assert got == {"b": (2, 1), "a": (2, 2), "c": (2, 3), "d": (2, 4)}


def test_tfidf_rows_count_pairs_where_the_texts_lie(spark):
    """Words and pairs of neighbours, repeated and null keys, null texts: as if every term were a row."""
    from textlab.functions import text as TX
    rows = [(i % 17 if i % 13 else None, "ab"[i % 2], [f"w{(i * j) % (5 + i % 3)}" for j in range(i % 9)] or None) for i in range(80)]
    every = spark.createDataFrame(rows, "id long, split string, tokens array<string>")
    for docs in (every, every.where("id is not null").dropDuplicates(["id"])):
        both = docs.withColumn("tokens", TX.ngrams_1_2("tokens"))
        for k in (7, 40, 1000):
            for fit in (None, F.col("split") == "a"):
                got = FE.tfidf_rows(docs, "id", "tokens", k, fit_on=fit, pairs=True, keep=["split"])
                want = FE._tfidf_rows_joined(both, "id", "tokens", k, both.where(fit) if fit is not None else None).join(docs.select("id", "split"), "id")
                got, want = [sorted((r.id if r.id is not None else -1, r.split, list(r.idx), [round(v, 9) for v in r.val]) for r in x.collect()) for x in (got, want)]
                if docs is every:
                    want = [w for w in want if w[0] >= 0]
                assert got == want


def test_lsa_needs_no_shuffle_of_terms(spark, monkeypatch):
    stored, held = FE.stored, []
    monkeypatch.setattr(FE, "stored", lambda df, name: held.append((name, stored(df, name))) or held[-1][1])
    docs = spark.createDataFrame([(i, ["a", "b", "a", f"rare{i}"]) for i in range(50)], "id long, tokens array<string>")
    plan = FE.tfidf_rows(docs, "id", "tokens", 3, pairs=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    assert [n for n, _ in held] == ["word-totals", "word-codes"]
