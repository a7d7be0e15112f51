"""Trained scores: held-out quality, determinism, fixed ranges, odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import quality as Q
from textlab.llm import toxicity as T
from textlab.llm.queries import QUERIES
from tests.conftest import SF01

RNG = np.random.default_rng(0)
FILLER = [f"{a}{b}{c}" for a in ("th", "er", "on", "lo", "ma") for b in ("in", "ou", "a") for c in ("ng", "ly", "s", "t")]


def sentence(n):
    return " ".join(RNG.choice(FILLER, n))


def insult(seen):
    word = RNG.choice(["blockhead", "dimwit", "nitwit"])
    return word if seen else word[:-2] + RNG.choice(list("xyz01")) + word[-2:]


def corpus(n, seen):
    y = np.arange(n) % 3 == 0
    return [(f"{sentence(RNG.integers(5, 80))} {insult(seen) if t else ''} {sentence(9)}").encode() for t in y], y.astype(int)


@pytest.fixture(scope="module")
def toxic_model():
    return T.fit(*corpus(900, True))


def test_unseen_misspellings(toxic_model):
    texts, y = corpus(400, False)
    import pyarrow as pa
    data, at = T.separated(pa.array([t.decode() for t in texts]))
    p = toxic_model.probability(T.most_toxic(toxic_model, data, at))
    assert ((p >= 0.7) == y).mean() > 0.95


def test_scores_of_one_text_do_not_depend_on_its_neighbours(toxic_model):
    import pyarrow as pa
    texts = ["", "dimwit", "a", "die nitwit " * 50, None, " . ", "blockhea", "é" * 9]
    together = T.most_toxic(toxic_model, *T.separated(pa.array(texts)))
    alone = [T.most_toxic(toxic_model, *T.separated(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone)


def test_toxicity_odd_inputs(spark, toxic_model):
    df = spark.createDataFrame([(1, None), (None, "dimwit"), (2, ""), (2, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = T.score(df, toxic_model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert max(rows, key=lambda r: r.score).doc_id is None
    assert T.score(df.limit(0), toxic_model).count() == 0
    constant = T.fit([], np.array([]))
    assert all(r.score < 0.5 for r in T.score(df, constant).collect())
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    texts, y = T.training_sample(df, labels)
    assert len(texts) == len(y) <= 1


def test_toxicity_query(spark):
    rows = QUERIES["op3_toxicity"](spark, SF01).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [s for s, y in held if y]
    assert np.mean([s > c for s in good for c, y in held if not y]) > 0.7


def test_features_only_from_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts, _ = T.training_sample(docs, labels)
    assert {int(t.split()[1]) for t in texts} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def rated(n):
    y = np.arange(n) % 3
    make = [lambda: " ".join([RNG.choice(FILLER)] * 30), lambda: sentence(30) + " " + "dimwit " * 8, lambda: sentence(30).capitalize() + "."]
    return [make[g]().encode() for g in y], y


def test_grades_are_ordered_and_held_out_documents_fit():
    model = Q.fit(rated(600))
    assert (np.diff(model.cuts) > 0).all()
    texts, y = rated(300)
    tails = model.tails(np.array([model.position(t) for t in texts]))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails[:, 0] >= 0.5) == (y > 0)).mean() > 0.95
    expected = tails.sum(1)
    assert expected[y == 0].mean() < expected[y == 1].mean() < expected[y == 2].mean()


def test_quality_gradient():
    """The loss falls: the fit is better than the start on its own rows."""
    texts, y = rated(90)
    rows = np.arange(90)

    def loss(model):
        t = model.tails(np.array([model.position(x) for x in texts]))
        full = np.concatenate([np.ones((90, 1)), t, np.zeros((90, 1))], 1)
        return -np.log(np.maximum(full[rows, y] - full[rows, y + 1], 1e-9)).mean()
    assert loss(Q.fit((texts, y), epochs=20)) < 0.5 * loss(Q.fit((texts, y), epochs=0))


def test_quality_odd_inputs(spark):
    model = Q.fit(rated(300))
    df = spark.createDataFrame([(1, None), (None, "one"), (2, ""), (2, ""), (3, "é\n\n")], "doc_id long, text string").withColumn("expected_grade", F.lit("clash"))
    rows = Q.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.expected_grade <= 2 for r in rows)
    kept = Q.keep(df, model)
    assert kept.columns == df.columns and kept.count() <= 5
    assert Q.keep(df, Q.fit(([], np.array([])))).count() == 5
    assert Q.score(df.limit(0), model).count() == 0


def test_quality_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality"](spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    clean = [rows[r.doc_id].kept for r in labels if r.quality == 1 and not r.toxic]
    junk = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1


M32 = (1 << 32) - 1


def plain_position(model, text):
    """A text's place on the quality scale, one feature at a time."""
    def mix(x):
        x = (x ^ x >> 16) * 0x7FEB352D & M32
        x = (x ^ x >> 15) * 0x846CA68B & M32
        return (x ^ x >> 16) & Q.BUCKETS - 1

    def kind(b):
        return 0 if b in b"\t\n\x0b\x0c\r " else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 8
    grams = [mix(text[i] * 65536 + text[i + 1] * 256 + text[i + 2]) for i in range(len(text) - 2)]
    words, last_shape, last = [], 0, None
    for w in text.split():
        shape = kind(w[0]) + kind(w[-1]) * 256 + min(len(w), 12) * 65536
        words += [mix(shape + 1), mix((shape * 31 + last_shape * 131071 + 2) & M32), mix(3 + (w == last))]
        last_shape, last = shape, w
    s = sum(float(model.weights[g]) for g in grams) / len(grams) if grams else 0.0
    s += sum(float(model.weights[w + Q.BUCKETS]) for w in words) / (len(words) / 3) if words else 0.0
    return s * Q.SCALE


def plain_toxicity(model, text):
    """A text's score by its most toxic word, one n-gram at a time."""
    def fold(b):
        if b >= 128:
            return b
        return b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or chr(b) in "'*@$_-+" else 0
    words, word = [], []
    for b in [*map(fold, text), 0]:
        if b:
            word.append(b)
        elif word:
            words, word = [*words, word], []
    scores = []
    for w in words:
        spelt, found = [0, *w, 0], []
        for n in T.NGRAMS:
            for i in range(len(spelt) - n + 1):
                h = 0
                for b in spelt[i:i + n]:
                    h = (h * 0x01000193 + b + 1) & M32
                h ^= h >> 15
                found.append(float(model.weight[((h * 0x2C1B3C6D + n & M32) >> 9) & T.BUCKETS - 1]))
        scores.append(sum(found) / max(len(found), 1) + model.bias)
    z = model.slope * max(scores, default=-20.0) + model.shift
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scores_equal_a_plain_scorer(spark, toxic_model, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["", None, " ", "a", "ab", "  again again  again", "It's 9 o'clock\x0b\x1c é", "x" * 5000, "\nA A"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if name == "toxicity":
        got = {r.doc_id: r.score for r in T.score(df, toxic_model).collect()}
        want = {k: plain_toxicity(toxic_model, (t or "").encode()) for k, t in rows}
    else:
        model = Q.fit_rows(Q.graded_rows(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), sample=60), epochs=5)
        got = {r.doc_id: r.expected_grade for r in Q.score(df, model).collect()}
        want = {k: float(model.tails(np.array([plain_position(model, (t or "").encode())])).sum()) for k, t in rows}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-7), k


def test_one_text_of_several_under_a_key_is_always_the_same(spark):
    rows = [(i % 20, f"text {i} of many") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, Q.graded_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).collect())) for n in (1, 7))
    assert a == b and len(a) == 20
    labels = labels.withColumn("toxic", F.col("quality"))
    a, b = (T.training_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels)[0] for n in (1, 7))
    assert a == b


def test_the_fit_in_a_task_is_the_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = Q.graded_rows(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), sample=50)
    held = sorted(rows.collect())
    here = Q.fit(([r.text.encode() for r in held], np.array([r.grade for r in held])), epochs=3)
    there = Q.fit_rows(rows, epochs=3)
    assert np.array_equal(here.weights, there.weights) and np.allclose(here.cuts, there.cuts)
    assert Q.fit_rows(rows.limit(0)).position(b"any text") == 0.0
