"""Recall against brute force; exact scores, ranks and ties."""

import numpy as np
from pyspark.sql import functions as F

from textlab.llm import ann
from textlab.llm.queries import QUERIES
from tests.conftest import SF01


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = x.astype(np.float64) @ x[ids.index(q)].astype(np.float64)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = [(v, -s) for s, v in order[:k]]
    return out


def check(rows, want, least):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {q for q, w in want.items() if w}
    hits = total = 0
    for q, w in want.items():
        mine = got.get(q, [])
        assert [r.rank for r in mine] == list(range(1, len(w) + 1))
        keys = [(-r.score, r.vec_id) for r in mine]
        assert keys == sorted(keys) and len({r.vec_id for r in mine}) == len(mine) and q not in {r.vec_id for r in mine}
        hits += len({r.vec_id for r in mine} & {v for v, _ in w})
        total += len(w)
        exact = dict(w)
        assert all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in mine if r.vec_id in exact)
    assert hits >= least * total
    return hits / max(total, 1)


def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF01}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32)
    check(QUERIES["op7_nearest_neighbours"](spark, SF01).collect(), brute(ids, x, [i for i in ids if i % 20 == 0]), 0.9)


def test_many_leaves_and_rounds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=64).collect()
    check(got, brute(list(range(1500)), x, list(range(0, 1500, 20))), 0.9)


def test_equal_vectors_ties_nulls_few_rows(spark):
    good = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0]), (101, [0.5, 0.5]), (120, [-1.0, 0.25])]
    odd = [(200, None), (220, [0.0, 0.0]), (240, [float("nan"), 1.0]), (260, [float("inf"), 1.0]), (280, [None, 1.0]), (None, [1.0, 1.0]), (300, [])]
    df = spark.createDataFrame(good + odd + good[:2], "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    ids, x = [i for i, _ in good], np.array([v for _, v in good], np.float32)
    assert check(ann.nearest(df, F.col("vec_id") % 20 == 0).collect(), brute(ids, x, [i for i in ids if i % 20 == 0]), 1.0) == 1.0
    few = df.where("vec_id in (100, 101)")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(100, 1, 101, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 100"), F.col("vec_id") % 20 == 0).count() == 0
