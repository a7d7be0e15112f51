"""Token ids in binary files: one zstandard frame for each document, with a shared dictionary.

The files of a folder follow the order of the keys.  A short document alone
compresses badly, so a dictionary is trained once on serialised id arrays and
shared by all files; every document is a frame of its own, and can be read
without its neighbours.

    dictionary.zstd        the dictionary
    part-<n>-<unique>.ids  header: MAGIC, bytes per id, SHA-256 of the dictionary
                           frames, one after the other
                           index: Arrow stream of (key, offset, size, start, n_tokens)
                           footer: place of the index, number of documents, MAGIC
    files/                 Parquet: (part, name, documents, n_tokens, size), one row a file

``offset`` and ``size`` place a frame in its file; ``start`` counts the ids before it
in its file.  A task that is run again writes a file of another name; only files
that ``files/`` names count.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import slices, texts
from .latin import beyond_latin, latin_words
from .remember import Remembered

MAGIC = b"TOKENID1"
HEADER, FOOTER = struct.Struct("<8sI32s"), struct.Struct("<QQ8s")
DICTIONARY = "dictionary.zstd"
#: Largest dictionary in bytes; it is trained on the ids of one window of
#: ``SAMPLE_CHARS`` characters from each of at most ``SAMPLE`` texts (those first in hash
#: order).  It decides sizes only, never what is read back.
DICTIONARY_BYTES, SAMPLE, SAMPLE_CHARS = 64 << 10, 2000, 2048
LEVEL = 3
#: Words in one generation of a worker's memory.
REMEMBERED = 300_000
#: Bytes of frames that a reader takes at once (a longer frame alone).
READ_BYTES = 4 << 20


# --- files on any store that the workers share ---

def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:") or "://" not in folder:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return pafs.FileSystem.from_uri(folder)


# --- ids of whole texts ---

class ByteIds:
    """Ids of whole texts by a byte-level tokenizer file, through the tokenizers library.

    Such a tokenizer cuts a text into words by a pattern and encodes each word by
    itself.  Texts of Latin letters are cut by the same pattern here, and the library
    encodes each distinct word once; other texts, and those that may hold a special
    token's string, go to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        self.memory = Remembered(self.learn, REMEMBERED)

    def encode(self, docs: list[str]) -> list[bytes]:
        """Each text's ids and the end id as little-endian integers of ``width`` bytes."""
        cut = [None if beyond_latin(d) or "<|" in d else latin_words(d) for d in docs]
        get = self.memory.of(w for w in cut if w is not None).__getitem__
        return [(self._library([d])[0] if w is None else b"".join(map(get, w))) + self.end for d, w in zip(docs, cut)]

    def _library(self, docs: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(docs, add_special_tokens=False)]

    def learn(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        # a space and letters: such words, one after the other, are cut as they were
        spaced = [w for w in words if w[0] == " " and w[1:].isalpha()]
        for a in range(0, len(spaced), 4096):
            part = spaced[a:a + 4096]
            e = self.tokenizer.encode("".join(part), add_special_tokens=False)
            number = np.array(e.word_ids, np.int64)
            if number[-1] != len(part) - 1:
                yield from zip(part, self._library(part))
                continue
            at = (np.searchsorted(number, np.arange(len(part) + 1)) * self.width).tolist()
            ids = np.array(e.ids, self.kind).tobytes()
            yield from ((w, ids[b:c]) for w, b, c in zip(part, at, at[1:]))
        rest = list(words.difference(spaced))
        for a in range(0, len(rest), 4096):
            yield from zip(rest[a:a + 4096], self._library(rest[a:a + 4096]))


@lru_cache(maxsize=2)
def byte_ids(path: str, end_id: int) -> ByteIds:
    return ByteIds(path, end_id)


# --- dictionary ---

def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialised id arrays.  Too few arrays to train on: their own bytes
    serve as one; none at all: empty."""
    arrays = [a for a in arrays if a]
    total = sum(map(len, arrays))
    try:
        if len(arrays) >= 16 and total >= 8 * 1024:
            return zstandard.train_dictionary(min(size, total // 4), arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        pass  # the trainer finds nothing that repeats
    return b"".join(arrays)[:size]


def dictionary_sample(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> list[bytes]:
    """Serialised ids of one window a document, of about ``SAMPLE`` different texts first in hash order.

    Their share of the hash range follows from the number of rows, so few rows leave the tasks."""
    share = min(2 * SAMPLE / max(docs.count(), 1), 1.0)
    place = F.pmod(F.xxhash64(F.length(text), F.lit(3)), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    at = F.shiftright(F.xxhash64(text, F.lit(17)), 1)
    window = docs.where(F.length(text) > 0).select(F.substring(F.col(text), place.cast("int"), F.lit(SAMPLE_CHARS)).alias("window"), at.alias("at"))
    few = window.where(F.abs("at") < int(share * (1 << 62))).groupBy("at").agg(F.min("window").alias("window"))
    rows = few.orderBy("at").limit(SAMPLE).collect()  # bounded: SAMPLE x SAMPLE_CHARS characters
    return byte_ids(path, end_id).encode([r["window"] for r in rows])


def _coded(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


# --- writing ---

def _write_part(folder: str, path: str, end_id: int, dictionary: bytes, batches: Iterator[pa.RecordBatch]):
    """One file of the batches' documents (key, text); yields its row of ``files``."""
    store, place = _store(folder)
    ids = byte_ids(path, end_id)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_coded(dictionary), write_checksum=True).compress
    out, keys, sizes, counts = None, [], [], []
    for batch in batches:
        for part in slices(batch, "text"):
            if out is None:
                name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{place}/{name}")
                out.write(HEADER.pack(MAGIC, ids.width, hashlib.sha256(dictionary).digest()))
            arrays = ids.encode([t.decode() for t in texts(part.column("text"))])
            frames = [pack(a) for a in arrays]
            out.write(b"".join(frames))
            keys.append(part.column("key"))
            sizes.append(np.fromiter(map(len, frames), np.int64, len(frames)))
            counts.append(np.fromiter(map(len, arrays), np.int64, len(arrays)) // ids.width)
    if out is None:
        return
    size, n = np.concatenate(sizes), np.concatenate(counts)
    offset, start = HEADER.size + np.cumsum(size) - size, np.cumsum(n) - n
    index = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *map(pa.array, (offset, size, start, n))],
                                       ["key", "offset", "size", "start", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as w:
        w.write_batch(index)
    raw = sink.getvalue()
    out.write(raw)
    at = HEADER.size + int(size.sum())
    out.write(FOOTER.pack(at, len(n), MAGIC))
    out.close()
    yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "documents": [len(n)],
                                      "n_tokens": [int(n.sum())], "size": [at + len(raw) + FOOTER.size]},
                                     schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()),
                                                       ("n_tokens", pa.int64()), ("size", pa.int64())]))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes every whole text's ids and the end id to ``folder``; returns its files.

    ``folder`` has to be new, on a store that driver and executors share.  Documents
    come in ascending order of the key, rows with null keys first, rows of one key in
    their order in the table.  Null text: the empty text, the end id alone.  Other
    columns are not read.  An empty table: a folder with a dictionary and no file.
    """
    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    dictionary = train_dictionary(dictionary_sample(docs, path, end_id, key, text))
    with store.open_output_stream(f"{place}/{DICTIONARY}") as out:
        out.write(dictionary)
    # the place in the table deals the rows of one key over several files too
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("__at"))
    ordered = rows.repartitionByRange("key", "__at").sortWithinPartitions("key", "__at").drop("__at")
    ordered.mapInArrow(lambda batches: _write_part(folder, path, end_id, dictionary, batches),
                       "part int, name string, documents long, n_tokens long, size long").write.parquet(f"{folder}/files")
    return docs.sparkSession.read.parquet(f"{folder}/files")


# --- reading ---

class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        store, place = _store(folder)
        if dictionary is None:
            dictionary = read_dictionary(folder)
        self.file = store.open_input_file(f"{place}/{name}")
        magic, self.width, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        end = self.file.size() - FOOTER.size
        at, documents, closing = FOOTER.unpack(self.file.read_at(FOOTER.size, end))
        if magic != MAGIC or closing != MAGIC:
            raise ValueError(f"{name} is no file of token ids, or is not whole")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = pa.ipc.open_stream(self.file.read_at(end - at, at)).read_all().combine_chunks()
        if self.index.num_rows != documents:
            raise ValueError(f"{name}: the index does not hold {documents} documents")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_coded(dictionary)).decompress

    def ids(self, row: int) -> np.ndarray:
        """The ids of one document, read by its frame alone."""
        offset, size = (self.index.column(c)[row].as_py() for c in ("offset", "size"))
        return np.frombuffer(self.unpack(self.file.read_at(size, offset)), f"<u{self.width}")

    def scan(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first row, end row, ids of each) of all documents, some megabytes of frames at once."""
        offset, size = (self.index.column(c).to_numpy() for c in ("offset", "size"))
        a, n = 0, len(offset)
        while a < n:
            b = max(int(np.searchsorted(offset + size, offset[a] + READ_BYTES, "right")), a + 1)
            raw = memoryview(self.file.read_at(int(offset[b - 1] + size[b - 1] - offset[a]), int(offset[a])))
            cuts = (offset[a:b] - offset[a]).tolist()
            yield a, b, [np.frombuffer(self.unpack(raw[c:c + s]), f"<u{self.width}") for c, s in zip(cuts, size[a:b].tolist())]
            a = b


def read_dictionary(folder: str) -> bytes:
    store, place = _store(folder)
    with store.open_input_stream(f"{place}/{DICTIONARY}") as f:
        return f.read()


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files with ``base``: the ids in all files before (a window over files, not documents)."""
    table = spark.read.parquet(f"{folder}/files")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return table.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(spark: SparkSession, folder: str, kind: str, more: str, columns) -> DataFrame:
    """One task a file: (key, start, n_tokens) and what ``columns`` makes of each document's ids."""
    dictionary = read_dictionary(folder)  # DICTIONARY_BYTES at most

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(folder, row["name"], dictionary)
                for a, b, ids in file.scan():
                    part = file.index.slice(a, b - a)
                    start = pa.array(part.column("start").to_numpy() + row["base"])
                    yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), start, part.column("n_tokens").combine_chunks(),
                                                      columns(ids)], ["key", "start", "n_tokens", more.split()[0]])

    table = files(spark, folder).select("name", "base")
    return table.repartition(max(1, spark.read.parquet(f"{folder}/files").count())).mapInArrow(
        run, f"key {kind}, start long, n_tokens long, {more}")


def read_ids(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids array<int>) of every document; ``start``: ids of all
    documents before it in the folder; ``kind``: the key's type."""
    def lists(ids):
        at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32)))
    return _read(spark, folder, kind, "ids array<int>", lists)


def checksums(spark: SparkSession, folder: str, kind: str = "long") -> DataFrame:
    """(key, start, n_tokens, ids_crc32): CRC-32 of each document's ids as little-endian
    unsigned 32-bit integers."""
    return _read(spark, folder, kind, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()))
