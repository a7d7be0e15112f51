"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``EDITS`` edits share, whole and nearly in place, one of the
``EDITS + 1`` segments that the shorter is cut into.  Every line is filed under
its own segments and looks up the few substrings, chosen by length and by what
earlier and later segments leave of the edits, where such a segment could stand
in it.  Lines that meet under a key are verified: first by a histogram of their
characters, then by an edit distance that keeps, in bits, the diagonals of the
band that each number of edits reaches.

Keys carry five bytes of a line's identifier, not its text.  Texts are fetched
only for lines that share a key with another line.  Documents without such a
line, or without a line to drop, are mostly spared a shuffle by a small filter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .arrow import map_text, maybe_in, stored, texts
from .components import connected_components, links_within, spanning_links
from .substring_dedup import POWERS, _ranges

EDITS = 2
#: Shorter lines (in characters, ends stripped) are compared for equality only: a few
#: edits make another line of them.  Blank lines are left alone.
SHORTEST = 16
#: Lines of one key in one task, about.
BLOCK = 2048
STEP_BYTES = 2 << 20
#: Bits of a lookup key and of the part of an identifier that goes with it.  Lines
#: that share either by chance only meet for nothing.
KEY_BITS, SHORT_BITS = 48, 40


def lines_of(text: bytes) -> list[str]:
    return [x.strip(" \t\r\x0b\x0c") for x in text.decode().split("\n")]


def _line_rows(whole: DataFrame) -> DataFrame:
    """(__row, __key, place, id) of every line that is not blank; id: MD5 of the stripped line."""
    def step(batch):
        row, place, ids = [], [], []
        for i, t in enumerate(texts(batch.column("__text"))):
            for j, line in enumerate(lines_of(t)):
                if line:
                    row.append(i)
                    place.append(j)
                    ids.append(hashlib.md5(line.encode()).digest())
        own = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("__row").take(own), batch.column("__key").take(own), pa.array(place, pa.int32()), pa.array(ids, pa.binary())],
                                          ["__row", "__key", "place", "id"])

    return map_text(whole, ["__row", "__key", "__text"], "__text", "__row long, __key long, place int, id binary", step)


def cut(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first place, length) of each of the ``edits + 1`` segments of lines of a length; the later ones are longer."""
    parts = edits + 1
    base, more = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at = at + size
    return out


def probes(length: np.ndarray, edits: int):
    """(lines, first place, end, kind) of the substrings that lines of these lengths look up;
    kind says which segment of which length is meant, and whether the line is filed there too."""
    for shorter in range(edits + 1):
        for i, (at, size) in enumerate(cut(length - shorter, edits)):
            later = edits - i
            for shift in range(max(-i, shorter - later), min(i, shorter + later) + 1):
                first = at + shift
                ok = np.flatnonzero((first >= 0) & (first + size <= length) & (size > 0))
                kind = (length[ok] - shorter) * (edits + 1) + i
                yield ok, first[ok], first[ok] + size[ok], kind, shorter == 0 and shift == 0


def _probe_rows(docs: DataFrame, edits: int, shortest: int) -> DataFrame:
    """(key, id, filed): each line's lookups, made distinct within a step."""
    def step(batch):
        lines = {x for t in texts(batch.column("__text")) for x in lines_of(t) if len(x) >= shortest}
        if not lines:
            return None
        lines = sorted(lines)
        ids = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:SHORT_BITS // 8], "big") for x in lines], np.int64)
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        length = np.array([len(x) for x in lines], np.int64)
        start = np.cumsum(length) - length
        found = list(probes(length, edits))
        row, first, end, kind = (np.concatenate([f[k] for f in found]) for k in range(4))
        filed = np.repeat([f[4] for f in found], [len(f[0]) for f in found])
        key = (_ranges(codes, start[row] + first, start[row] + end, POWERS[0]) ^ (kind.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(64 - KEY_BITS)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(filed)], ["key", "short_id", "filed"])

    return map_text(docs, ["__text"], "__text", "key long, short_id long, filed boolean", step, STEP_BYTES)


def within_edits(codes: np.ndarray, first: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether lines a and b (rows; flat ``codes`` with ``2 * edits + 1`` zeros or more
    between lines) are within ``edits`` edits of each other, for all pairs at once.

    reach[d] holds a bit for each diagonal of the band: set if, with d edits, some
    alignment of the characters read so far ends there.
    """
    out = np.zeros(len(a), bool)
    off = length[b] - length[a]
    live = np.flatnonzero(np.abs(off) <= edits)
    kind = np.uint16
    # diagonal s (b ahead of a by s) is bit s + edits; before any character d insertions reach s <= d
    reach = [np.full(len(live), sum(1 << s + edits for s in range(d + 1)), kind) for d in range(edits + 1)]
    i = 0
    while len(live):
        done = length[a[live]] == i
        if done.any():
            hit = live[done]
            out[hit] = reach[edits][done] >> (off[hit] + edits).astype(kind) & kind(1) > 0
        stay = ~done & (reach[edits] > 0)
        if not stay.all():
            live, reach = live[stay], [r[stay] for r in reach]
            if not len(live):
                break
        c, at = codes[first[a[live]] + i], first[b[live]] + i
        equal = np.zeros(len(live), kind)
        for s in range(-edits, edits + 1):
            if i + s >= 0:
                equal |= (codes[at + s] == c).astype(kind) << kind(s + edits)
        band = kind((1 << 2 * edits + 1) - 1)
        now = [reach[0] & equal]
        for d in range(1, edits + 1):
            now.append((reach[d] & equal | reach[d - 1] | reach[d - 1] >> kind(1) | now[d - 1] << kind(1)) & band)
        reach, i = now, i + 1
    return out


def _linker(edits: int):
    def links(rows: pa.Table, group: np.ndarray):
        ids = rows.column("id").to_pylist()
        lines = rows.column("line").to_pylist()
        length = np.array([len(x) for x in lines], np.int64)
        pad = "\0" * (2 * edits + 1)
        flat = np.frombuffer((pad + pad.join(lines) + pad).encode("utf-32-le"), np.uint32)
        first = np.cumsum(length + 2 * edits + 1) - length
        line_no = np.repeat(np.arange(len(lines)), length)
        at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        counts = np.bincount(line_no * 16 + (flat[at] & 15), minlength=16 * len(lines)).reshape(-1, 16)
        codes = flat.copy()
        codes[at] += 1  # a real character is never the zero between lines

        def near(a, b):
            close = np.abs(counts[a] - counts[b]).sum(1) <= 2 * edits
            close[close] = within_edits(codes, first, length, a[close], b[close], edits)
            return close

        a, b = spanning_links(group, length, edits, near)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in a.tolist()], pa.binary()), pa.array([ids[i] for i in b.tolist()], pa.binary())], ["a", "b"])
    return links


def _short(id_: Column) -> Column:
    return F.conv(F.hex(F.substring(id_, 1, SHORT_BITS // 8)), 16, 10).cast("long")


def _order() -> Column:
    """A line's place in the order of keys (nulls last), then rows, then lines."""
    return F.struct(F.col("__key").isNull().alias("last"), F.col("__key").alias("key"), F.col("__row").alias("row"), F.col("place").alias("place"))


def _texts_of(whole: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the wanted lines (id, row, place), cut from the documents."""
    places = wanted.groupBy(F.col("row").alias("__r")).agg(F.collect_list(F.struct("place", "id")).alias("places"))
    held = maybe_in(whole, F.col("__row"), wanted, F.col("row"), "__maybe").where("__maybe").select("__row", "__text").join(places.hint("merge"), F.col("__row") == F.col("__r"))

    def step(batch):
        ids, out = [], []
        for t, places in zip(texts(batch.column("__text")), batch.column("places").to_pylist()):
            lines = lines_of(t)
            for p in places:
                ids.append(p["id"])
                out.append(lines[p["place"]])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["id", "line"])

    return map_text(held, ["__text", "places"], "__text", "id binary, line string", step)


def repeated_lines(whole: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """(row, places): the lines that go, for (__row: unique, __key, __text)."""
    rows = stored(_line_rows(whole), "lines")
    lines = stored(rows.groupBy("id").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines")
    # lines that share a key with another line, of which one is filed there
    w = Window.partitionBy("key")
    met = stored(_probe_rows(whole, edits, shortest)
                 .withColumn("low", F.min("short_id").over(w)).withColumn("high", F.max("short_id").over(w)).withColumn("any", F.max("filed").over(w))
                 .where(F.col("any") & (F.col("low") != F.col("high"))).select("key", "short_id").distinct(), "line-keys")
    wanted = (lines.join(met.select("short_id").distinct(), _short(F.col("id")) == F.col("short_id"), "left_semi")
              .select("id", "first.row", "first.place"))
    known = stored(_texts_of(whole, wanted).withColumn("__short", _short(F.col("id"))), "line-texts")
    meetings = met.join(known, F.col("short_id") == F.col("__short")).select("key", "id", "line")
    links = links_within(meetings, ["key"], "id", block, F.length("line"), _linker(edits), "a binary, b binary")
    found = connected_components(links)
    members = found.union(found.select("component", "component").distinct().toDF("node", "component"))
    # the first line of every class with more than one line
    linked = lines.join(members, F.col("id") == F.col("node")).select("id", "component", "first", "n")
    heads = linked.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("head"))
    heads = linked.join(heads, F.col("component") == F.col("c")).select("id", "head")
    alone = lines.where("n > 1").join(members, F.col("id") == F.col("node"), "left_anti").select("id", F.col("first").alias("head"))
    heads = heads.union(alone).withColumnRenamed("id", "__id")
    stays = (F.col("__row") == F.col("head.row")) & (F.col("place") == F.col("head.place"))
    gone = rows.join(heads, (F.col("id") == F.col("__id")) & ~stays)
    return gone.groupBy(F.col("__row").alias("__r")).agg(F.collect_set("place").alias("places"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST,
                        block: int = BLOCK, counts: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, all other columns as they are.

    Lines are parts between newlines, their ends stripped; blank ones do not count.
    Equal lines, and lines of ``shortest`` characters or more that are linked by at
    most ``edits`` edits, directly or through others, form a class; of each class
    exactly one occurrence stays, the first by key (null keys last), then by row, then
    by place in the text.  ``key`` is an integer column; repeated and null keys are
    rows of their own, which follow their place in the table.  Null texts stay null
    and have no lines.  ``counts`` adds n_lines and n_removed.  Empty: no rows.

    The documents are written once with a number for each row, so that every step
    knows a row by that number.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    held = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "line-docs")
    whole = held.select("__row", F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    gone = stored(repeated_lines(whole, edits, shortest, block).withColumnRenamed("places", "__places"), "lines-gone")
    split = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__places", i)), "\n")
    more = [F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
            F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("long").alias("n_removed")] if counts else []
    marked = maybe_in(held, F.col("__row"), gone, F.col("__r"), "__maybe")
    # joins with texts are planned alike at every size, so that what a small table shuffles tells about a large one
    some = marked.where("__maybe").join(gone.hint("merge"), F.col("__row") == F.col("__r"), "left").select(
        *[F.when(F.col("__places").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in docs.columns], *more)
    none = marked.where(~F.col("__maybe")).withColumn("__places", F.lit(None).cast("array<int>")).select(*docs.columns, *more)
    return some.union(none)
