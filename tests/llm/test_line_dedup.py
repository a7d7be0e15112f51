"""Line classes against all pairs of lines; the edit distance against its recursion."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.llm import line_dedup as L
from textlab.llm.queries import QUERIES
from tests.conftest import SF001


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def kept_texts(rows, edits=2, shortest=16):
    """Texts without repeated lines, one for each row (key, text); rows of one key follow their place."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    places = [(r, j, x.strip(" \t\r\x0b\x0c")) for r in order if rows[r][1] is not None for j, x in enumerate(rows[r][1].split("\n"))]
    places = [p for p in places if p[2]]
    lines = list(dict.fromkeys(p[2] for p in places))
    label = list(range(len(lines)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(lines):
        for j in range(i):
            if min(len(a), len(lines[j])) >= shortest and abs(len(a) - len(lines[j])) <= edits and distance(a, lines[j]) <= edits:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    at, head, gone = {x: root(i) for i, x in enumerate(lines)}, {}, set()
    for k, j, x in places:
        if head.setdefault(at[x], (k, j)) != (k, j):
            gone.add((k, j))
    return [t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (r, j) not in gone) for r, (_, t) in enumerate(rows)]


def brute(rows, edits=2, shortest=16):
    """Rows (key, text) with unique keys -> texts without repeated lines."""
    return dict(zip((k for k, _ in rows), kept_texts(rows, edits, shortest)))


def edited(rng, line, n):
    for _ in range(n):
        i = rng.randrange(len(line))
        line = rng.choice([line[:i] + line[i + 1:], line[:i] + rng.choice("abcé") + line[i:], line[:i] + "z" + line[i + 1:]])
    return line


def corpus(seed, n=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcd é") for _ in range(rng.randint(10, 40))) for _ in range(25)]
    out = [(i, "\n".join(edited(rng, rng.choice(stock), rng.randint(0, 4)) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    return out + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "  " + stock[0] + "\r\nshort\n" + stock[0])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12), st.integers(1, 3))
def test_banded_distance(a, b, edits):
    pad = "\0" * (2 * edits + 1)
    flat = np.frombuffer((pad + a + pad + b + pad).encode("utf-32-le"), np.uint32).copy()
    first, length = np.array([2 * edits + 1, 4 * edits + 2 + len(a)]), np.array([len(a), len(b)])
    got = L.within_edits(flat, first, length, np.array([0, 1]), np.array([1, 0]), edits)
    assert got.tolist() == [distance(a, b) <= edits] * 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=6, max_size=14), st.integers(0, 2), st.randoms())
def test_lines_within_the_edits_share_a_key(a, n, rng):
    b = a
    for _ in range(n):
        i = rng.randrange(len(b))
        b = rng.choice([b[:i] + b[i + 1:], b[:i] + "a" + b[i:], b[:i] + "b" + b[i + 1:]])

    def keys(x, only_filed):
        return {(x[f[0]:e[0]], k[0]) for ok, f, e, k, filed in L.probes(np.array([len(x)]), 2) if len(ok) and (filed or not only_filed)}
    if distance(a, b) <= 2:
        short, long = sorted((a, b), key=len)
        assert keys(short, True) & keys(long, False)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash")).withColumn("id", F.lit(0)).repartition(4)
    out = L.drop_repeated_lines(df, **how)
    assert out.columns == df.columns
    return {r.doc_id: r.text for r in out.collect()}


def test_brute_force(spark):
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block=4) == brute(rows)


def test_many_lines_under_one_key(spark):
    rng = random.Random(8)
    stem = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, edited(rng, stem, rng.randint(0, 6))) for i in range(200)]
    assert run(spark, rows, block=16) == brute(rows)


def test_repeats_null_keys_empty(spark):
    rows = [(None, "the same long line"), (5, "the same long line\nanother long line"), (5, "the same long line\nanother long line"), (6, "the same long lime")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in L.drop_repeated_lines(df, counts=True).collect()), key=str)
    assert got == sorted([(None, "", 1, 1), (5, rows[1][1], 2, 0), (5, "", 2, 2), (6, "", 1, 1)], key=str)
    assert L.drop_repeated_lines(df.limit(0)).count() == 0


def test_exactly_one_of_each_line_whatever_the_keys(spark):
    line = "a line that many documents hold"
    rows = [(None, f"{line}\n{i}") for i in range(3)] + [(-5, line + "s"), (-(1 << 62), "x\n" + line), (0, "short"), (7, "short\nshort"), (7, "short\n \n\n"),
                                                       (7, "short\n \n\n"), (None, line), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("__row", F.lit("clash")).withColumn("head", F.lit(1)).drop("__row")
    got = sorted(((r.doc_id, r.text) for r in L.drop_repeated_lines(df).collect()), key=str)
    assert got == sorted(zip((k for k, _ in rows), kept_texts(rows)), key=str)
    assert sum(line in t for _, t in got) == 1 and sum("short" in t for _, t in got) == 1


def test_query_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in QUERIES["op10_line_dedup"](spark, SF001).collect()}
    want = brute(docs)
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows.values()) > 0
    for k, t in docs:
        assert rows[k].kept_sha256 == hashlib.sha256((want[k] or "").encode()).hexdigest()
        assert rows[k].n_lines == len(t.split("\n"))
