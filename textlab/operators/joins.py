"""Joins and set operations: anti joins, lookups, unions, pair explosion.

No side is forced to broadcast: AQE measures it at run time, broadcasts it only
under ``spark.sql.autoBroadcastJoinThreshold``, and splits skewed partitions of a
sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of the membership filter for each wanted key, and its largest size (64 MB): a
#: larger set of keys has no filter, and every row takes the join.
BITS_PER_KEY, MOST_BITS = 8, 1 << 29


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, name: str = "__maybe") -> DataFrame:
    """``df`` with boolean ``name``: false only where ``key`` is none of ``keys`` (one column).

    A bitmap of hashed keys, as large as their number asks for, is built by
    aggregation (maps are merged bit by bit) and broadcast in pieces of 4 KB.  Rows that
    cannot match can then skip a shuffle; the join that follows decides on the others.
    """
    n = keys.count()
    bits = max(1 << 15, 1 << (BITS_PER_KEY * max(n, 1) - 1).bit_length())
    if bits > MOST_BITS:
        return df.withColumn(name, F.lit(True))

    def slot(k):
        return F.pmod(F.xxhash64(k), F.lit(bits)) + 1

    pieces = keys.select(slot(F.col(keys.columns[0])).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    place = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2 == 1
    marked = df.withColumn("__in", F.bitmap_bucket_number(slot(key))).join(F.broadcast(pieces), F.col("__in") == F.col("__piece"), "left")
    return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__in", "__piece", "__bits")


def anti_join_natural(full: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of ``full`` not in ``sample`` on all common columns; null matches
    null; duplicates of ``full`` stay (pandas merge indicator semantics).

    Rows meet on a hash of the common columns; the columns themselves are compared
    null-safely behind it and are not sort keys.  Rows whose hash the sample cannot
    hold are not shuffled."""
    common = [c for c in full.columns if c in sample.columns]
    right = sample.select(F.xxhash64(*common).alias("__h"), *[F.col(c).alias(f"__s_{c}") for c in common])
    left = maybe_in(full.withColumn("__h", F.xxhash64(*common)), F.col("__h"), right.select("__h"))
    same = F.col("l.__h") == F.col("r.__h")
    for c in common:   # equal or both null; written so that it is checked behind the hash, not sorted by
        same = same & (F.size(F.array_distinct(F.array(F.col(f"l.{c}"), F.col(f"r.__s_{c}")))) == 1)
    decided = left.where("__maybe").alias("l").join(right.alias("r"), same, "left_anti")
    return left.where("not __maybe").unionByName(decided).drop("__h", "__maybe")


def anti_join_key(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``; rows whose key it cannot hold are not shuffled."""
    keys = other.select(key)
    marked = maybe_in(df, F.col(key), keys)
    return marked.where("not __maybe").unionByName(marked.where("__maybe").join(keys, key, "left_anti").select(*marked.columns)).drop("__maybe")


def lookup_join(df: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(dim, key, how)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def dedup_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(cols) if cols else None)


def pair_explode(df: DataFrame, pair_id: str, cols: Sequence[str], label: str,
                 variant_names: Sequence[str] | None = None) -> DataFrame:
    """Each (pair_id, text_a, text_b, label) row becomes one row per text, in
    column order, keeping pair_id and the variant name."""
    names = list(variant_names or cols)
    arr = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("text")) for n, c in zip(names, cols)])
    return df.select(pair_id, label, F.posexplode(arr).alias("variant_pos", "v")) \
             .select(pair_id, label, F.col("variant_pos").cast("long").alias("variant_pos"),
                     "v.variant", "v.text")


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)
