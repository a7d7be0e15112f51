"""Packing: every id once, gapless sequences, exact subset sums, small padding."""

import itertools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlab.llm import packing
from textlab.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF001

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(1, 40))
def test_fill_is_the_closest_sum(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    got = packing.fill(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in got.items())
    sums = {sum(c) for r in range(len(lengths) + 1) for c in itertools.combinations(lengths, r)}
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tABc'1. <|>")), max_size=50), max_size=4))
def test_word_ids_equal_library(texts):
    got = packing.word_ids(PATH, 2).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def check(rows, docs):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs.items():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(by_sequence)


def test_query_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op6_packing"](spark, SF001).collect()
    used = check(rows, docs)
    total = sum(r.length for r in rows)
    assert used - 1 <= total / 4096 * 1.01 + 1


def test_levels_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(i, "w " * (i * 37 % 90)) for i in range(300)] + [(None, None), (None, None), (7, "w " * 10)],
                               "doc_id long, text string").withColumnRenamed("text", "body")
    from pyspark.sql import functions as F
    df = df.withColumn("text", F.lit(3)).withColumn("offset", F.lit("x"))
    cut = packing.pieces(df, PATH, text="body", capacity=64)
    assert cut.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = packing.pack(cut, capacity=64, group=40).collect()
    assert len(out) == cut.count()
    total, sequences = sum(r.length for r in out), len({r.sequence_id for r in out})
    assert sequences <= total // 64 + 3
    assert sum(r.doc_id is None for r in out) == 2
    assert packing.pack(packing.pieces(df.limit(0), PATH, text="body")).count() == 0


def test_lengths_that_never_fill_a_window_end(spark):
    df = spark.range(400).selectExpr("id as doc_id", "0L as start", "40L as length", "0L as ids_crc32", "40L as doc_tokens")
    df = df.union(spark.range(300).selectExpr("id", "40L", "64L", "0L", "104L"))
    out = packing.pack(df, capacity=64, group=30).collect()
    assert len(out) == 700 and len({r.sequence_id for r in out}) == 700 and all(r.offset == 0 for r in out)
