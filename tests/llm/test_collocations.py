"""Phrase collocations against plain Python and DuckDB; the quicksort against counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from textlab.llm import collocations as C
from textlab.llm.queries import ORACLE, QUERIES

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, max_words=3, least=10, top=2000, cover=50):
    """Expected rows from (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, max_words + 1):
                    if i + m <= len(words):
                        f[lang, tuple(words[i:i + m])] += 1
    out = []
    for lang in n:
        found = []
        for (x, p), a in f.items():
            if x != lang or len(p) < 2 or a < least:
                continue
            cuts = [(1000000 * a * a // (f[x, p[:k]] * f[x, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = [b for (y, q), b in f.items() if y == x and b >= least and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= cover * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[x, p[:k]], f[x, p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def ran(spark, rows, schema="lang string, text string", **more):
    got = C.collocations(spark.createDataFrame(rows, schema).repartition(3), **more)
    assert got.columns == NAMES
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("words, n, least", [(3, 2000, 10), (40, 3000, 3), (4, 1, 1), (1, 50, 5)])
def test_equal_parts_are_counts(words, n, least):
    rng = np.random.default_rng(words)
    keys = [rng.integers(0, words, n) for _ in range(3)]
    size = rng.integers(1, 4, n)
    for d in (1, 2):  # suffixes that end
        keys[d] = np.where((rng.random(n) < 0.2) | (keys[d - 1] < 0), -1, keys[d])
    want = Counter()
    for a, b, c, s in zip(*map(np.ndarray.tolist, keys), size.tolist()):
        for p in ((a,), (a, b), (a, b, c)):
            if -1 not in p:
                want[p] += s
    got = {}
    for depth, at, total in C.equal_parts(keys, size, least):
        for i, t in zip(at.tolist(), total.tolist()):
            phrase = tuple(int(k[i]) for k in keys[:depth])
            assert phrase not in got
            got[phrase] = t
    assert got == {p: c for p, c in want.items() if c >= least}


def texts(seed=1, n=400, vocabulary=12):
    rng = random.Random(seed)
    words = ["The", "of", "é", "tion", "a-b", "\x00", "ÉA", *(f"w{k}" for k in range(vocabulary))]
    return [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 40))))
            for _ in range(n)]


def test_against_plain_python(spark):
    rows = texts()
    assert ran(spark, rows) == plain(rows)


def test_pairs_of_hot_words_are_routed_by_three(spark, monkeypatch):
    rows = texts(2)
    monkeypatch.setattr(C, "HOT", 1 << 40)  # every word is hot
    assert ran(spark, rows) == plain(rows)
    assert ran(spark, rows, max_words=4, least=3) == plain(rows, 4, 3)
    monkeypatch.setattr(C, "HOT", 0)
    assert ran(spark, rows) == plain(rows)


def test_other_lengths_and_limits(spark):
    rows = texts(3, 300, 3)
    assert ran(spark, rows, max_words=4, least=4, top=7, cover=70) == plain(rows, 4, 4, 7, 70)
    assert ran(spark, rows, max_words=2, least=5) == plain(rows, 2, 5)


def test_odd_rows(spark):
    rows = [("en", None), (None, None), ("en", ""), ("en", "a b " * 30), ("en", "a b " * 30), (None, "A B. " * 12), ("x", "solo"), ("en", "long word " * 40_000)]
    assert ran(spark, rows) == plain(rows)
    assert ran(spark, []) == []
    clash = [("en", "p q " * 20, 1, 2, "z", "w")]
    got = ran(spark, clash, "lang string, text string, n int, f int, phrase string, words string")
    assert got == plain([r[:2] for r in clash])


def test_products_beyond_64_bits(spark):
    counts = [(4 * 10**12, 4 * 10**12, 4 * 10**12)]
    df = spark.createDataFrame(counts, "a long, l long, r long").selectExpr("cast(a as decimal(15,0)) a", "cast(l as decimal(15,0)) l", "cast(r as decimal(15,0)) r")
    assert df.selectExpr("(a * a * cast(1000000 as decimal(7,0))) div (l * r) as s").first()["s"] == 1000000


def test_query_against_duckdb(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select {', '.join(NAMES)} from ({ORACLE['op11_collocations']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, sf).select(*NAMES).collect()) == want
    assert len(want) > 100
