"""SimHash groups against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textlab.llm import simhash as S
from textlab.llm.components import connected_components, spanning_links
from textlab.llm.queries import QUERIES
from tests.conftest import SF001


def plain_fingerprint(text, k=4):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keys, fps, distance=4):
    parent = {i: i for i in range(len(fps))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= distance).tolist():
            parent[root(i)] = root(i + 1 + j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            r = root(i)
            least[r] = min(least.get(r, k), k)
    return [least.get(root(i)) for i in range(len(fps))]


def test_fingerprints(spark):
    texts = ["", None, "one", "a b c d", "A b\tC d E\x0bf", "É È a  b", "x " * 2000, "word%d " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r.fp % (1 << 64) for r in S.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    native = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def planted(n, seed):
    rng = random.Random(seed)
    out = [0]
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(x)
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(out))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components_of(spark, fps, **how):
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(S.near_links(df, **how)).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(found.get(x, x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_links_equal_all_pairs(spark):
    fps = planted(150, 1)
    plain = {}
    for x, g in zip(fps, plain_groups(list(range(len(fps))), fps)):
        plain.setdefault(g, set()).add(x)
    plain = {frozenset(g) for g in plain.values()}
    assert components_of(spark, fps) == plain
    assert components_of(spark, fps, block=3) == plain  # every key is dealt into blocks


def spanned(n, links):
    """The parts that spanning_links leaves of rows 0..n-1 of one group with these links."""
    near = lambda a, b: np.array([(x, y) in links for x, y in zip(a.tolist(), b.tolist())], bool)
    part = list(range(n))
    for a, b in zip(*(x.tolist() for x in spanning_links(np.zeros(n, int), np.zeros(n, int), 0, near))):
        part = [part[a] if p == part[b] else p for p in part]
    return part


def test_earlier_links_outlast_later_ones():
    a, b, c, d = spanned(4, {(2, 3), (0, 2), (1, 3)})
    assert a == b == c == d
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(3, 40)
        links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, n))}
        plain = list(range(n))
        for a, b in links:
            plain = [plain[a] if p == plain[b] else p for p in plain]
        got = spanned(n, links)
        assert len(set(zip(got, plain))) == len(set(got)) == len(set(plain))


def test_links_of_one_key_only(spark):
    # paths whose links differ by one bit in each of the same four blocks, so that only one key holds them
    def chain():
        x = rng.getrandbits(64)
        out = [x]
        for _ in range(3):
            for bits in ((0, 9), (9, 18), (18, 27), (27, 36)):
                x ^= 1 << rng.randrange(*bits)
            out.append(x)
        return out
    rng = random.Random(4)
    chains = [chain() for _ in range(200)]
    assert components_of(spark, [x for c in chains for x in c]) == {frozenset(c) for c in chains}


def test_one_large_group(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = list({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(1500)})
    assert len(components_of(spark, fps, block=200)) == 1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (300, 301), (301, 300), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 301: 300}
    assert connected_components(links.limit(0)).count() == 0


def test_query_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    rows = {r.doc_id: r for r in QUERIES["op4_simhash"](spark, SF001).collect()}
    fps = [plain_fingerprint(d.text) for d in docs]
    want = plain_groups([d.doc_id for d in docs], fps)
    assert len(rows) == len(docs)
    for d, f, c in zip(docs, fps, want):
        assert (rows[d.doc_id].fingerprint, rows[d.doc_id].component_id) == (f"{f:016x}", c)
    assert len(set(want)) < len(want)


def test_nulls_ties_repeats(spark):
    df = spark.createDataFrame([(4, None), (None, ""), (3, " "), (3, " "), (9, "alpha beta gamma"), (None, "one two")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_groups(df).collect()), key=str)
    assert got == sorted([(4, 3), (None, 3), (3, 3), (3, 3), (9, 9), (None, None)], key=str)
    kept = S.keep_one(df)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted(df.where("doc_id in (3, 9) or text = 'one two'").collect(), key=str)
    assert S.near_groups(df.limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    import corpus_pipeline
    rows = [(4, None, "a"), (None, "", "a"), (3, " ", "b"), (3, " ", "b"), (3, " ", "a"), (3, "", "a"), (9, "alpha beta gamma", "a"),
            (None, "one two", "b"), (None, "one two", "a"), (None, "one  two", "a"), (None, "other words here", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    got = sorted(out.collect(), key=str)
    assert len(got) == 4 and all(tuple(r) in rows for r in got)
    assert [r.doc_id for r in got if r.text in ("", " ")] == [3] and sum(r.text in ("one two", "one  two") for r in got) == 1
    assert {r.doc_id for r in got} == {3, 9, None} and got == sorted(corpus_pipeline.near_dedup(spark, df.repartition(5), "").collect(), key=str)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0
