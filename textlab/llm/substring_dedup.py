"""Removal of word sequences that recur, by repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text.  Three steps:

1.  Confirm recurring passages.  The smallest hash among a window's shingles of
    ``SHINGLE`` words is its anchor; equal windows have equal anchors at the same
    place.  Consecutive windows with one anchor form a segment, so about one row
    leaves the task for every dozen words.  Counting anchors and segments settles
    most windows: an anchor met once has no recurring window, and a segment met
    twice has only recurring ones.  Only the segments that are left, next to a
    passage's ends, are opened, and their windows are counted.
2.  Compile automata.  Each task reads shards, bounded slices of the documents, and
    compiles each shard's confirmed passages (as windows that cover them, in the
    shard's own word numbers) into one Aho-Corasick automaton.
3.  Stream every document through its shard's automaton; the words that an
    occurrence covers go.

Documents cross the network once; steps 1 and 2 use the same exchange.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_text, stored, texts

WINDOW, SHINGLE = 35, 8
#: Bytes of text that one vectorised step, and one automaton, handles.
STEP_BYTES = 1 << 20
_P1, _P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of the two polynomial hashes
_COUNT = 4096  # more than the windows of a segment
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in self.bases)
        return self.up[:n], self.down[:n]


POWERS = _Powers(_P1), _Powers(_P2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _ranges(values: np.ndarray, first: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hash of values[first:end] for each range, alike wherever the range stands."""
    up, down = powers.to(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)])
    return _mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


class Words:
    """The words of some texts in one buffer: hashes, the text of each, and each text's first."""

    def __init__(self, docs: list[bytes]):
        data = np.frombuffer(b"\n" + b"\n".join(docs) + b"\n", np.uint8)
        space = _SPACE[data]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.hash = _ranges(data.astype(np.uint64) + np.uint64(1), first, end, POWERS[0])
        starts = np.cumsum([1, *(len(d) + 1 for d in docs)])
        self.bounds = np.searchsorted(first, starts, "left")
        self.doc = np.repeat(np.arange(len(docs)), np.diff(self.bounds))


def segments(words: Words, window: int, shingle: int):
    """(first word, number of windows, anchor hash, segment hash) of every segment."""
    h, n = words.hash, len(words.hash)
    if n < window:
        return None
    places = np.arange(n - shingle + 1)
    anchors = _ranges(h, places, places + shingle, POWERS[0])
    low = np.uint64((1 << 32) - 1)
    least, have, want = (anchors & ~low) | places.astype(np.uint64), 1, window - shingle + 1
    while have < want:
        add = min(have, want - have)
        least = np.minimum(least[:-add], least[add:])
        have += add
    at = (least & low).astype(np.int64)
    whole = np.flatnonzero(words.doc[:n - window + 1] == words.doc[window - 1:])
    if not len(whole):
        return None
    at = at[whole]
    new = np.concatenate([[True], (whole[1:] != whole[:-1] + 1) | (at[1:] != at[:-1])])
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate([start, [len(whole)]]))
    first, anchor_at = whole[start], at[start]
    seg = _ranges(h, first, first + count + window - 1, POWERS[1])
    return first, count, anchors[anchor_at], seg


def _segment_rows(whole: DataFrame, window: int, shingle: int) -> DataFrame:
    """(k, h, at, anchor, seg): at is the first word times ``_COUNT`` plus the number of windows."""
    assert window - shingle < _COUNT - 1
    kind = whole.schema["k"].dataType.simpleString()

    def step(batch):
        words = Words(list(texts(batch.column("text"))))
        found = segments(words, window, shingle)
        if found is None:
            return None
        first, count, anchor, seg = found
        doc = words.doc[first]
        at = (first - words.bounds[doc]) * _COUNT + count
        own = pa.array(doc)
        return pa.RecordBatch.from_arrays([batch.column("k").take(own), batch.column("h").take(own), pa.array(at), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))],
                                          ["k", "h", "at", "anchor", "seg"])

    return map_text(whole, ["k", "h", "text"], "text", f"k {kind}, h struct<x:long,y:int>, at long, anchor long, seg long", step, STEP_BYTES)


def _window_rows(marked: DataFrame, window: int) -> DataFrame:
    """Two hashes of every window of the segments to open."""
    kind = marked.schema["k"].dataType.simpleString()

    def step(batch):
        batch = batch.filter(batch.column("opened"))
        if not batch.num_rows:
            return None
        words = Words(list(texts(batch.column("text"))))
        row, place, sure = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            for s in spans:
                if s["open"]:
                    first, n = divmod(s["at"], _COUNT)
                    row += [i] * n
                    place += range(first, first + n)
                    sure += [s["sure"]] * n
        row, place = np.array(row), np.array(place)
        first = place + words.bounds[row]
        a, b = (_ranges(words.hash, first, first + window, p).view(np.int64) for p in POWERS)
        own = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column("k").take(own), batch.column("h").take(own), pa.array(place.astype(np.int32)), pa.array(sure, pa.bool_()),
                                           pa.array(a), pa.array(b)], ["k", "h", "place", "sure", "a", "b"])

    return map_text(marked, ["k", "h", "text", "spans", "opened"], "text", f"k {kind}, h struct<x:long,y:int>, place int, sure boolean, a long, b long", step, STEP_BYTES)


def cover(docs: list[list[bytes]], confirmed: list[list[tuple[int, int]]], window: int) -> list[np.ndarray]:
    """For each text (as words), which of its words an occurrence of a confirmed passage covers.

    ``confirmed``: per text, runs (first window, number of windows) that recur.  A
    passage is put into the automaton as the windows that tile it, so that a text
    holding only part of a longer passage is judged by its own run."""
    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words, runs in zip(docs, confirmed):
        at = 0
        runs = sorted(runs)
        while at < len(runs):
            a, b = runs[at][0], runs[at][0] + runs[at][1]
            at += 1
            while at < len(runs) and runs[at][0] <= b:
                b = max(b, runs[at][0] + runs[at][1])
                at += 1
            for first in [*range(a, b - 1, window), b - 1]:
                automaton.add_word(tuple(number.setdefault(w, len(number) + 1) for w in words[first:first + window]))
    out = [np.zeros(len(w), bool) for w in docs]
    if not len(automaton):
        return out
    automaton.make_automaton()
    for words, hit in zip(docs, out):
        if len(words) >= window:
            for last, _ in automaton.iter(tuple([number.get(w, 0) for w in words])):
                hit[last - window + 1:last + 1] = True
    return out


def _automata(ready: DataFrame, window: int) -> DataFrame:
    kind = ready.schema["k"].dataType.simpleString()

    def step(batch):
        split = [t.split() for t in texts(batch.column("text"))]
        runs = [[divmod(s["at"], _COUNT) for s in spans or () if s["sure"]] + [(p, 1) for p in places or ()]
                for spans, places in zip(batch.column("spans").to_pylist(), batch.column("places").to_pylist())]
        hits = cover(split, runs, window)
        kept = [b" ".join([w for w, gone in zip(words, hit.tolist()) if not gone] if hit.any() else words) for words, hit in zip(split, hits)]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(w) for w in split], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()),
                                           pa.array(kept, pa.binary()).cast(pa.string())], ["k", "n_words", "n_removed", "text"])

    return map_text(ready, ["k", "text", "spans", "places"], "text", f"k {kind}, n_words long, n_removed long, text string", step, STEP_BYTES)


def _of_row(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` left-joined to ``rows`` (k, h, and what to add)."""
    rows = rows.withColumnRenamed("k", "__k").withColumnRenamed("h", "__h")
    return df.join(rows, F.col("k").eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h")), "left").drop("__k", "__h")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_words, n_removed, text): every text without the words covered by a
    window whose word sequence also starts anywhere else, same text included.

    Words are runs of anything but ASCII white space; ``text`` has those that
    stay, joined by one space.  Windows are judged on the input.  Null and empty
    texts have no words; texts shorter than a window keep all.  A repeated row is
    another place where its words stand; repeated and null keys keep their rows.
    Empty table: no rows.
    """
    # a row is known by its key and 96 bits of its text's hashes, so versions under one key stay apart
    whole = docs.select(F.col(key).alias("k"), F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("y")).alias("h"), F.col(text).alias("text"))
    rows = _segment_rows(whole, window, shingle)
    # anchors met more than once; mixed: with several segments
    again = (rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("n > 1")
             .select(F.col("anchor").alias("a"), _fold("anchor").alias("f"), (F.col("low") != F.col("high")).alias("mixed")))
    # the second key makes both sides shuffles of their own, so that Spark can split an anchor met very often
    found = rows.join(again, (F.col("anchor") == F.col("a")) & (_fold("anchor") == F.col("f"))).select("k", "h", "at", "anchor", "seg", "mixed")
    found = stored(found, "recurring-segments")  # read several times below
    plain = found.where(~F.col("mixed")).select("k", "h", "at", F.lit(True).alias("sure"), F.lit(False).alias("open"))
    # a recurring segment of a mixed anchor is opened once, to be met by the windows of the others
    mixed, one = found.where("mixed").select("k", "h", "at", "anchor", "seg"), F.hash("k", "h", "at")
    kinds = mixed.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("c"), F.min(one).alias("one")).select(
        F.col("anchor").alias("a"), F.col("seg").alias("s"), _fold("seg").alias("f"), "c", "one")
    opened = mixed.join(kinds, (F.col("anchor") == F.col("a")) & (F.col("seg") == F.col("s")) & (_fold("seg") == F.col("f"))).select(
        "k", "h", "at", (F.col("c") > 1).alias("sure"), (one == F.col("one")).alias("open"))
    spans = plain.union(opened).groupBy("k", "h").agg(F.collect_set(F.struct("at", "sure", "open")).alias("spans"))
    marked = _of_row(whole, spans.withColumn("opened", F.exists("spans", lambda s: s["open"]))).withColumn("opened", F.coalesce("opened", F.lit(False)))
    windows = _window_rows(marked, window)
    met = windows.groupBy("a", "b").agg((F.count(F.lit(1)) + F.max(F.col("sure").cast("int"))).alias("met")).where(F.col("met") > 1).select(
        "a", "b", _fold("a").alias("f"))
    places = windows.where(~F.col("sure")).withColumn("f", _fold("a")).join(met, ["a", "b", "f"], "left_semi").groupBy("k", "h").agg(F.collect_set("place").alias("places"))
    return _automata(_of_row(marked, places), window).withColumnRenamed("k", key)


def _fold(name: str):
    return F.pmod(F.col(name), F.lit(1009))
