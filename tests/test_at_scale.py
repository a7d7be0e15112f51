"""Steps that must not make a row of every token, nor repeat their work, at any size."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlab.functions import text as TX
from textlab.operators import augment as A
from textlab.operators import experiments as E
from textlab.operators import features as FE
from textlab.operators import vocab as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """Texts with repeated keys, without words and null."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("Aa bé C d eE f g".split(" ")) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return spark.createDataFrame(rows + rows[:5] + [(3, "g a other A"), (61, None), (62, "  \t"), (61, "Aa f")], "k long, t string").repartition(5)


def words(text):
    return (text or "").split()


def together(rows, of):
    """Per key the values of its texts' words, in order of position, then ascending."""
    out = {}
    for k, t in rows:
        out.setdefault(k, []).extend((i, x) for i, w in enumerate(words(t)) for x in of(w))
    return {k: [x for _, x in sorted(v)] for k, v in out.items()}


def test_translations_of_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_CHARS", 50)
    lex = {"aa": ["x"], "bé": ["z", "y"], "f": [None], "x": ["back"]}
    legs = spark.createDataFrame([(s, d) for s, ds in lex.items() for d in ds], "src string, dst string")
    got = A.translations(odd, "k", "t", [legs])
    assert "Generate" not in plan(got)
    rows = [(r.k, r.t) for r in odd.collect()]
    want = together(rows, lambda w: [d or w for d in lex.get(w.lower(), [w])])
    found = [(r.k, r.translated) for r in got.collect()]
    assert dict(found) == {k: " ".join(v) for k, v in want.items()} and len(found) == len(want)
    every = A.parallel_translate(odd, "k", "t", {"one": [legs], "two": [legs.where("src = 'aa'"), legs]}).collect()
    assert sorted((r.k, r.t or "", r.one) for r in every) == sorted((k, t or "", " ".join(want[k])) for k, t in rows)
    twice = together(rows, lambda w: {"aa": ["back"]}.get(w.lower()) or [d or w for d in lex.get(w.lower(), [w])])
    assert {r.k: r.two for r in every} == {k: " ".join(v) for k, v in twice.items()}


def test_distinct_words_in_parts(odd, monkeypatch):
    monkeypatch.setattr(A, "HELD_WORDS", 3)
    got = A.distinct_words(odd, "t")
    assert "Generate" not in plan(got)
    assert sorted(r.w for r in got.collect()) == sorted({w.lower() for r in odd.collect() for w in words(r.t)})


def test_sequences_move_documents_not_tokens(spark, odd):
    t = odd.select("k", TX.tokenize_ws("t").alias("tokens"))
    vocab = V.build_vocab(t, "k", "tokens")
    known = {r.token: (r.n, r.idx) for r in vocab.collect()}
    rows = [(r.k, r.t) for r in odd.collect()]
    first, n = {}, {}
    for k, text in rows:
        for i, w in enumerate(words(text)):
            n[w], first[w] = n.get(w, 0) + 1, min(first.get(w, (k, i)), (k, i))
    order = sorted(n, key=lambda w: (-n[w], first[w]))
    assert known == {w: (n[w], i + 1) for i, w in enumerate(order)}
    got = V.texts_to_sequences(t, "k", "tokens", vocab, 4)
    assert "Generate" not in plan(got)
    assert {r.k: r.seq for r in got.collect()} == together(rows, lambda w: [known[w][1]] if known[w][1] < 4 else [])
    kept = V.custom_tokenizer(t, "k", "tokens", vocab, 4)
    assert {r.k: r.kept for r in kept.collect()} == together(rows, lambda w: [w] if known[w][1] < 4 else [])


def test_padding_keeps_the_type_of_the_ids(spark):
    df = spark.createDataFrame([(1, ["4", "5"]), (2, [])], "k long, seq array<string>")
    assert {r.k: r.padded for r in V.pad_pre(df, "seq").collect()} == {1: ["4", "5"], 2: ["0", "0"]}


def test_hashed_columns_are_counted_without_token_rows(spark, odd):
    got = E.sparse_counts(odd.select("k", TX.tokenize_ws("t").alias("w")), "k", "w", 5)
    assert "Generate" not in plan(got)
    column = {r.w: r.c for r in A.distinct_words(odd, "t").union(odd.select(F.explode(TX.tokenize_ws("t")))).distinct()
              .select("w", F.pmod(F.xxhash64("w"), F.lit(5)).alias("c")).collect()}
    want = {}
    for r in odd.collect():
        own = want.setdefault(r.k, {})
        for w in words(r.t):
            own[column[w]] = own.get(column[w], 0) + 1
    assert {r.k: dict(zip(r.idx, r.val)) for r in got.collect()} == want
    assert all(r.idx == sorted(r.idx) for r in got.collect())


def test_assembled_features_count_meta_once(spark, tmp_path, monkeypatch):
    """The meta features are stored, and no array as wide as the vocabulary is walked through."""
    from textlab.plans import feature_queries as Q
    docs = [(1, "alpha beta beta #tag", "en"), (2, "beta gamma", "de"), (3, "", "en"), (4, "alpha, delta! url", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    names = []
    monkeypatch.setattr(Q, "stored", lambda df, name, f=Q.stored: names.append(name) or f(df, name))
    got = Q.q_assemble_features(spark, str(tmp_path))
    assert names == ["meta"] and "vector_to_array" not in plan(got)
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].n_terms for i in (1, 2, 3, 4)] == [3, 2, 0, 3] and {r.n_features for r in rows.values()} == {6 + 8}
    assert rows[3].term_weight == rows[3].placed_weight == 0.0 and rows[1].num_words == 1.0 and rows[3].char_count == 0.0


def test_diversity_without_texts(spark):
    rows = [("a b", "a c"), ("a b", "a b c"), ("", " "), (None, ""), (None, "a"), (None, None), ("a a", "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    jac, changed = A.bt_diversity(F.col("a"), F.col("b"))
    got = df.select("a", "b", jac.alias("j"), changed.alias("c"))
    assert "array_intersect" not in plan(got)
    assert {(r.a, r.b): (r.j, r.c) for r in got.collect()} == {
        ("a b", "a c"): (1 / 3, 0.5), ("a b", "a b c"): (2 / 3, 1 / 3), ("", " "): (1.0, 0.0), (None, ""): (None, 0.0),
        (None, "a"): (None, None), (None, None): (None, None), ("a a", "a"): (1.0, 0.5)}


def test_tfidf_moves_blocks_not_terms(spark, odd, monkeypatch):
    monkeypatch.setattr(FE, "BLOCK_TERMS", 40)
    rows = [(r.k, words(r.t) + [None]) for r in odd.collect()] + [(None, ["a", "A A"]), (None, ["a"]), (90, None), (91, [])]
    docs = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    got = FE.tfidf(docs, "k", "w")
    assert "Generate" not in plan(got)
    counts = Counter((k, w) for k, ws in rows for w in ws or () if w is not None)
    df = Counter(w for _, w in counts)
    weight = {(k, w): n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for (k, w), n in counts.items()}
    norm = Counter()
    for (k, _), v in weight.items():
        norm[k] += v * v
    found = got.collect()
    assert len(found) == len(weight) and {(r.k, r.term) for r in found} == weight.keys()
    assert all(math.isclose(r.weight, weight[r.k, r.term] / math.sqrt(norm[r.k]), rel_tol=1e-12) for r in found)
    five = FE.tfidf(docs, "k", F.col("w"), digits=5, n_docs=F.lit(len(rows)))
    assert {(r.k, r.term): r.weight for r in five.collect()} == {(r.k, r.term): round(r.weight, 5) for r in found}
    assert FE.tfidf(docs.where("k > 89"), "k", "w").collect() == []
    # pairs are made within a row, also where a word is the same as a pair
    rows = [(1, ["a", "b", "a", "b"]), (2, ["a b", "c"]), (2, ["a"]), (3, ["a", "b c"]), (4, [])]
    docs = spark.createDataFrame(rows, "k long, w array<string>").coalesce(1)
    every = [(k, ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])]) for k, ws in rows]
    want = FE.tfidf(spark.createDataFrame(every, docs.schema), "k", "w")
    got = FE.tfidf(docs, "k", "w", pairs=True)
    assert {(r.k, r.term): r.weight for r in got.collect()} == pytest.approx({(r.k, r.term): r.weight for r in want.collect()})


def test_tfidf_shuffles_compressed_blocks_once(spark, monkeypatch):
    """What is shuffled are a block's documents, once, and its terms, as compressed bytes."""
    monkeypatch.setattr(FE, "BLOCK_TERMS", 60)
    rows = [(i % 40, [f"w{(i * j) % 11}" for j in range(i % 7)]) for i in range(200)]
    docs = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    got = FE.tfidf(docs, "k", "w", pairs=True)
    moved = [line for line in plan(got).splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) <= 4 and "terms" not in plan(got).split("FlatMapCoGroups")[1].split("FlatMapGroups")[0]
    every = [(k, ws + [f"{x} {y}" for x, y in zip(ws, ws[1:])]) for k, ws in rows]
    want = FE.tfidf(spark.createDataFrame(every, docs.schema), "k", "w")
    assert {(r.k, r.term): r.weight for r in got.collect()} == pytest.approx({(r.k, r.term): r.weight for r in want.collect()})
    terms = pa.array(["x", "", "ä b", "x"] + ["y"])[1:4]
    assert FE._unsqueezed(FE._squeezed(terms)).to_pylist() == terms.to_pylist()
