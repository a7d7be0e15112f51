"""Repeated windows against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.llm import substring_dedup as D
from textlab.llm.queries import QUERIES
from tests.conftest import SF001


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyzé") + rng.choice(["", "1", "2x", "\x1c"])
    passages = [[word() for _ in range(rng.randint(3, 25))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 20))]
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(words))
    return out + ["a b " * 60, "z " * 50, "z " * 3, "", None, out[3], out[3]]


def run(spark, texts, **how):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in D.remove_repeats(df, **how).collect()}
    return [got[i] for i, _ in rows]


def test_brute_force_small_windows(spark):
    texts = corpus(1)
    assert run(spark, texts, window=6, shingle=3) == brute(texts, 6)


def test_brute_force_window_as_in_production(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(10, 300))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts += [" ".join(w), " ".join(base[rng.randrange(60)].split()[5:60] + w)]
    assert run(spark, texts) == brute(texts, 35)


def test_repeated_rows_null_keys_versions(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "q a b c d e f"), (2, "x y z u v w t s"), (2, "other words here at all times now"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in D.remove_repeats(df, window=6, shingle=3).collect()), key=str)
    assert got == sorted([(k, *b) for (k, _), b in zip(rows, brute([t for _, t in rows], 6))], key=str)
    assert D.remove_repeats(df.limit(0)).count() == 0


def test_texts_of_one_32_bit_hash_and_no_key(spark):
    from pyspark.sql import Window
    # two of many texts share Spark's 32-bit hash; only the first has a passage that recurs
    made = spark.range(400_000).select(F.concat_ws(" ", *[F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdefgh"]).alias("text"))
    pairs = made.withColumn("h", F.hash("text")).withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1").orderBy("h", "text").limit(2).collect()
    one, other = (r.text for r in pairs)
    assert pairs[0].h == pairs[1].h
    texts = [one, other, one.replace(" h", " z")]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.text) for r in D.remove_repeats(df, window=6, shingle=3).collect())
    assert got == sorted(brute(texts, 6))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), max_size=6))
def test_equal_windows_have_equal_anchors(docs):
    words = D.Words([" ".join(d).encode() for d in docs])
    found = D.segments(words, 5, 2)
    flat, seen = [w for d in docs for w in d], {}
    for first, count, anchor, _ in zip(*(x.tolist() for x in found)) if found else ():
        for i in range(first, first + count):
            assert seen.setdefault(tuple(flat[i:i + 5]), anchor) == anchor


def test_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = brute([d.text for d in docs], 35)
    rows = {r.doc_id: r for r in QUERIES["op2_substring_dedup"](spark, SF001).collect()}
    assert len(rows) == len(docs) and sum(w[1] for w in want) > 0
    for d, (n, gone, kept) in zip(docs, want):
        r = rows[d.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
