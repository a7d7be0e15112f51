"""SimHash near duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a set of reference
fingerprints.  Two fingerprints within ``distance`` bits differ by no more than
that in every such coordinate, so a pair whose largest coordinate difference is
larger is discarded without comparing the fingerprints; survivors are verified.

Which pairs are looked at: the 64 bits are cut into ``distance + shared`` blocks,
and of two fingerprints within ``distance`` bits at least ``shared`` blocks are
equal, so both have the same key for some choice of ``shared`` blocks.  Keys are
grouped; of each group only a spanning forest of its links leaves the task.  A
key with very many fingerprints is dealt into blocks whose pairs are separate groups.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_text, stored, texts
from .components import connected_components, links_within, spanning_links

SHINGLE, DISTANCE, SHARED, SEED = 4, 4, 3, 42
#: Reference fingerprints (a multiple of 8); their distances are kept as one byte each.
REFERENCES = 16
#: Fingerprints of one key in one task, about.
BLOCK = 8192


def reference(i: int) -> int:
    return int.from_bytes(hashlib.md5(f"reference {i}".encode()).digest()[:8], "big", signed=True)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of an ASCII-lower-cased text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_digest
    hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())])
    bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(n, 64)
    whole = n // 255 * 255  # sums of 255 rows fit a byte
    count = bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, h, fp) of every whole text; h: a hash of the text.  Null text: no words, fingerprint 0."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        out = [fingerprint(t, shingle) for t in texts(batch.column("__text"))]
        return pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("h"), pa.array(out, pa.int64())], [key, "h", "fp"])

    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("h"), F.col(text).alias("__text"))
    return map_text(rows, rows.columns, "__text", f"`{key}` {kind}, h long, fp long", step)


def distance_table(fp: Column) -> list[Column]:
    """Distances to the references, eight to a long."""
    out = []
    for a in range(0, REFERENCES, 8):
        packed = F.lit(0).cast("long")
        for i in range(8):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(reference(a + i)))).cast("long"), 8 * i))
        out.append(packed.alias(f"d{a // 8}"))
    return out


def block_masks(distance: int, shared: int) -> list[int]:
    """Masks over every choice of ``shared`` of the ``distance + shared`` blocks of the 64 bits."""
    n = distance + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(blocks, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _linker(distance: int):
    """Spanning links of the rows of some whole groups."""
    def links(rows: pa.Table, group: np.ndarray):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        table = np.stack([rows.column(f"d{i}").to_numpy() for i in range(REFERENCES // 8)], 1).astype("<i8").view(np.uint8)

        def near(a, b):
            close = np.abs(table[a].astype(np.int16) - table[b]).max(1, initial=0) <= distance
            close[close] = np.bitwise_count(fp[a[close]] ^ fp[b[close]]) <= distance
            return close

        a, b = spanning_links(group, table[:, 0].astype(np.int16), distance, near)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])
    return links


def near_links(distinct: DataFrame, distance: int = DISTANCE, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that leave the same
    components as all pairs within ``distance`` bits."""
    masks = block_masks(distance, shared)
    fp = F.col("fp")
    rows = distinct.select("fp", *distance_table(fp), F.explode(F.array(*[
        F.struct(F.lit(i).cast("short").alias("choice"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("at")).select("*", "at.*").drop("at")
    first = F.col("d0").bitwiseAND(F.lit(255))
    return links_within(rows, ["choice", "key"], "fp", block, first, _linker(distance), "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                distance: int = DISTANCE) -> DataFrame:
    """(key, h, fp, component_id): component_id is the smallest key reachable over
    links of at most ``distance`` differing bits, the own key included.

    Null and empty texts have fingerprint 0, which links like any other.  Null
    keys are never the smallest unless a component has no key.  Repeated rows
    stay, with the same component.  An empty table gives an empty table.
    """
    return _members(docs, key, text, shingle, distance).select(F.col("__key").alias(key), "h", "fp", "component_id")


def _members(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(__key, h, fp, component, component_id) of every row; component: a fingerprint."""
    fps = stored(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "__key"), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("__key").alias("first"))
    found = connected_components(near_links(distinct.select("fp"), distance))
    member = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    # the fold keys make both sides shuffles of their own, so that Spark can split a large component or copy group
    least = member.groupBy("component").agg(F.min("first").alias("component_id")).withColumn("fold", _fold("component"))
    names = member.withColumn("fold", _fold("component")).join(least, ["component", "fold"]).select("fp", "component", "component_id")
    return fps.withColumn("fold", _fold("fp")).join(names.withColumn("fold", _fold("fp")), ["fp", "fold"]).drop("fold")


def _fold(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1009))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its near-duplicate group, all
    columns as they are; of a group without keys, all rows."""
    stay = near_groups(docs, key, text).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__k"), F.col("h").alias("__h")).distinct()
    return docs.join(stay, F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(text) == F.col("__h")), "left_semi")


def keep_single(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` of each near-duplicate group, all columns as they are.

    The smallest key stays (null keys come last), then the smallest hash of the
    text, then the smallest row by its columns; rows equal in all of them are
    alike, so it does not matter which is meant.
    """
    null = F.col("__key").isNull()
    each = _members(docs, key, text).groupBy("component", "__key", "h").agg(F.count(F.lit(1)).alias("n"))
    first = stored(each.groupBy("component").agg(F.min(F.struct(null.alias("null"), "__key", "h", "n")).alias("s")).select(
        F.col("s.__key").alias("__k"), F.col("s.h").alias("__h"), F.col("s.n").alias("__n")), "kept")

    def of(rows):
        return docs.join(rows, F.col(key).eqNullSafe(F.col("__k")) & (F.xxhash64(text) == F.col("__h")), "left_semi")

    # only rows with copies are gathered by key and text
    copies = of(first.where("__n > 1")).select(F.col(key).alias("__k"), F.xxhash64(text).alias("__h"), F.struct(*docs.columns).alias("__row"))
    one = copies.groupBy("__k", "__h").agg(F.min("__row").alias("__row")).select("__row.*")
    return of(first.where("__n = 1")).union(one)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
