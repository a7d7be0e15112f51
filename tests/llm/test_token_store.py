"""Token files: exact round trips against the tokenizers library, order, random access, odd tables."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlab.llm import token_store as T
from textlab.llm.queries import QUERIES, tokenizer_path
from textlab.sources.files import scratch_path
from textlab.sources.tables import read_table

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def want_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'aeinorst.,1 é<|>\x1c\x85\xa0")), max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    ids = T.byte_ids(PATH, 0)
    for text, raw in zip(texts, ids.encode(texts)):
        assert np.frombuffer(raw, ids.kind).tolist() == want_ids(text)


def test_memory_forgets_without_changing_ids():
    ids = T.ByteIds(PATH, 0)
    ids.memory.size = 3
    for text in ["one two three four five", "two six", "seven eight nine ten one", "two", ""] * 2:
        assert np.frombuffer(ids.encode([text])[0], ids.kind).tolist() == want_ids(text)
    assert len(ids.memory.young) < 12


def written(spark, rows, schema="doc_id long, text string"):
    folder = scratch_path(spark, "token-ids")
    T.write(spark.createDataFrame(rows, schema).repartition(3), folder, PATH)
    return folder


def test_round_trip_in_order(spark):
    rows = [(k * 7 % 50 - 5, f"text {k} 😀 " + "the same words " * (k % 9)) for k in range(50)] + [(100, None), (101, ""), (102, "x" * 200_000), (103, "<|endoftext|> a")]
    folder = written(spark, rows)
    got = sorted(T.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted(k for k, _ in rows)
    text, place = dict(rows), 0
    for r in got:
        assert r.ids == want_ids(text[r.key]) and r.start == place and r.n_tokens == len(r.ids)
        place += r.n_tokens


def test_one_document_alone(spark):
    folder = written(spark, [(k, f"document number {k} of the folder") for k in range(200)])
    for row in T.files(spark, folder).collect():
        file = T.TokenFile(folder, row["name"])
        for i in (0, file.index.num_rows - 1):
            assert file.ids(i).tolist() == want_ids(f"document number {file.index.column('key')[i].as_py()} of the folder")
    sizes = [file.index.column("size")[i].as_py() for i in range(file.index.num_rows)]
    assert max(sizes) < 40  # the shared dictionary makes short documents short frames


def test_another_dictionary_is_refused(spark):
    folder = written(spark, [(k, "some words here " * k) for k in range(40)])
    name = T.files(spark, folder).first()["name"]
    with pytest.raises(ValueError, match="another dictionary"):
        T.TokenFile(folder, name, b"not the one")


def test_leftover_files_of_lost_tasks_do_not_count(spark):
    folder = written(spark, [(1, "a b"), (2, "c")])
    store, place = T._store(folder)
    with store.open_output_stream(f"{place}/part-000000-lost.ids") as f:
        f.write(b"half a file")
    assert {r.key for r in T.checksums(spark, folder).collect()} == {1, 2}


def test_null_and_repeated_keys_and_empty_table(spark):
    rows = [(None, "a a"), (None, None), (3, "b"), (3, "b"), (-4, "c"), (None, "a a")]
    got = sorted(T.read_ids(spark, written(spark, rows)).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, None, None, -4, 3, 3]
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(want_ids(t)) for _, t in rows)
    assert T.read_ids(spark, written(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "x", "k", 5, 6)], "doc_id long, text string, key string, part int, start int")
    folder = scratch_path(spark, "token-ids")
    T.write(clash, folder, PATH)
    assert T.checksums(spark, folder).count() == 1


def test_query_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(read_table(spark, sf, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op13_token_store"](spark, sf).collect()}
    place = 0
    for key, text in docs:
        ids = want_ids(text)
        r = got[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)
    assert len(got) == len(docs)
