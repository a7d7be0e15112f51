"""Encoding against the tokenizers library, token by token, and exact round trips."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlab.llm import bpe
from textlab.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
CODEC = bpe.codec(PATH)


def same(texts):
    got = CODEC.encode(texts)
    for text, ids in zip(texts, got):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        ids = memoryview(ids).cast("i").tolist()
        assert ids == want, text
        assert CODEC.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aeinorst.,1 é<|>")), max_size=60), max_size=5))
def test_any_text(texts):
    same(texts)


@pytest.mark.parametrize("text", ["", " ", "  \n ", "a \n b", "x<|endoftext|> y<|endoftext|><|endoftext|>z ", "aaaaaaaaaaaaaaaaaaaaaaaa" * 40,
                                  "don't  I'll 'sx", "\x1c\x1d a\x85b", "​זה 数字 ١٢٣ ⅷ 😀😀", " " * 5000 + "end", "0123456789" * 300])
def test_edges(text):
    same([text])


def test_some_words_fail_and_are_merged_alike():
    words = [f" {a}{b}{c}".encode() for a in ("th", "er", "hors", "unt", "aer") for b in ("ones", "hed", "ion", "eal") for c in ("gest", "rest", "ies" * 30, "")]
    tokens, bounds = CODEC.encode_words(words)
    got = [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [CODEC.exact(w) for w in words]
    sizes = np.cumsum([0, *map(len, words)])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    greedy, owner = CODEC.greedy(data, sizes[:-1], sizes[1:])
    assert any(greedy[owner == i].tolist() != ids for i, ids in enumerate(got))
    merged, owner = CODEC.merged(data, sizes[:-1], sizes[1:])
    assert all(merged[owner == i].tolist() == ids for i, ids in enumerate(got))


def test_query_whole_table(spark):
    from tests.conftest import SF001
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    import hashlib
    rows = QUERIES["op5_bpe"](spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_empty_repeated_clashing(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7)], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df, PATH).collect()), key=str)
    assert got == sorted([(1, []), (None, [64, 275]), (2, []), (2, [])], key=str)
    assert sorted(r.text for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()) == ["", "", "", "a b"]
    assert bpe.encode(df.limit(0), PATH).count() == 0
