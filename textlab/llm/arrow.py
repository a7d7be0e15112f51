"""Small helpers for Arrow-batched work: text slices of bounded size and whole-buffer views."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_path

#: Text bytes that one vectorised step handles at once (one longer text is a step of its own).
SLICE_BYTES = 4 << 20


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Every text of a string column as UTF-8 bytes; null counts as the empty text."""
    data, at = text_view(column)
    whole = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield whole[a:b]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold ``limit`` bytes at most, or one row."""
    _, at = text_view(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def map_text(df: DataFrame, columns: Sequence[str], text: str, schema,
             step: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over the named columns, called on slices of bounded text."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out
    return df.select(*columns).mapInArrow(run, schema)


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from the flat values and the length of each row's list."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again: it
    is computed once, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter that ``maybe_in`` broadcasts, at any size of the data: 8 MB.
FILTER_BITS = 1 << 26


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """``df`` with boolean ``name``: false only where ``key`` is no ``wanted_key``.

    A bitmap of hashed keys, built and joined as 4 KB pieces of one fixed size in
    all, spares rows that cannot match a shuffle.  Where it is full it spares none;
    the join that follows decides."""
    def slot(k):
        return F.pmod(F.xxhash64(k), F.lit(FILTER_BITS)) + 1

    pieces = wanted.select(slot(wanted_key).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    place = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2 == 1
    joined = df.withColumn("__in", F.bitmap_bucket_number(slot(key))).join(F.broadcast(pieces), F.col("__in") == F.col("__piece"), "left")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__in", "__piece", "__bits")
