"""Exact dedup against DuckDB and against grouping by the normalised text."""

import hashlib
import re

from pyspark.sql import functions as F

from textlab.llm import exact_dedup as X

ROWS = [(5, "a  b"), (3, "a\tb"), (4, " a b"), (9, ""), (8, None), (7, " "), (7, " "), (None, "a\n b"), (None, "only"), (20, "x" * 9000 + " y"), (21, "x" * 9000 + "\x0b\x0by"),
        (22, "x" * 9000 + " z"), (30, "word, and other. " * 3000), (31, "word, and  other. " * 3000), (32, "é b"), (33, "é b"), (40, "a\x1cb"), (41, "a b ")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (k, _), t in zip(rows, norm):
        keys = [q for (q, _), u in zip(rows, norm) if u == t]
        keep = min((q for q in keys if q is not None), default=None)
        out.append((k, keep, len(keys), k == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("group_size", F.lit("q"))


def test_brute_force(spark):
    got = X.exact_groups(frame(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)
    assert X.exact_groups(frame(spark, ROWS).limit(0)).count() == 0


def test_colliding_identifiers_are_found_and_replaced(spark):
    def weak(chunk, round_no):
        return F.unhex(F.substring(F.md5(chunk), 1, 2)) if round_no < 2 else X.digest(chunk, round_no)
    rows = [(i, f"document {i % 40} " * 20) for i in range(120)]
    got = X.exact_groups(frame(spark, rows), identify=weak).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_chunks_resume_after_an_insertion(spark):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:i % 9 + 2] for i in range(4000))
    a, b = (r.c for r in spark.createDataFrame([(text,), ("new words first " + text,)], "t string").select(X.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == text and max(map(len, a)) <= X.MAX_CHUNK
    assert len(set(a) & set(b)) > 0.8 * len(a)
