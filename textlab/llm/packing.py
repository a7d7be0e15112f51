"""Packing documents into fixed windows by minimum bin slack.

A document longer than a window gives full windows at once; what is left of it
(and every shorter document) is a piece shorter than a window.  Pieces are dealt
into groups of bounded size.  Within a group each window takes the longest piece
left and the multiset of the other lengths left that fills it closest to its
capacity, found by a subset-sum over bit sets and traced back to counts per
length.  Windows that stay open go, as pieces, to the next level with fewer
groups, until one group closes the rest.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .arrow import map_text, texts
from .remember import Remembered

CAPACITY = 4096
#: Pieces in one group, about; the work of a group is bounded by it.
GROUP = 4096
#: Distinct words in one generation of a Python worker's memory.
REMEMBERED = 600_000


class WordIds:
    """ids of whole texts by a tokenizer that drops white space.

    Such a tokenizer never joins across white space, so a text's ids are those of
    its words (split at ASCII white space), and each distinct word is encoded once.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = Remembered(self.learn, REMEMBERED)
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, docs: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last.

        ASCII capitals are lowered first, as the tokenizer would, but not where
        the text may hold a special token's string."""
        words = [(d if b"<|" in d else d.lower()).split() for d in docs]
        get = self.memory.of(words).__getitem__
        return [b"".join(map(get, ws)) + self.end for ws in words]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """ids of new words."""
        # a full stop or comma behind an ASCII letter or digit is a word of its own
        tailed = [w for w in words if w[-1:] in (b".", b",") and w[-2:-1].isalnum()]
        known: dict[bytes, bytes] = {}
        words = words.difference(tailed)
        for w in (b".", b",", *(w[:-1] for w in tailed)):
            held = self.memory.get(w)
            if held is None:
                words.add(w)
            else:
                known[w] = held
        text = {w: w.decode() for w in words}
        plain = [w for w, t in text.items() if t.lower().isalpha() and (t.isascii() or max(t) < "\u0250")]
        for a in range(0, len(plain), 4096):
            part = plain[a:a + 4096]  # one word each to the tokenizer, so that its word numbers tell them apart
            e = self.tokenizer.encode(" ".join([text[w] for w in part]), add_special_tokens=False)
            if e.word_ids[-1] != len(part) - 1:
                continue
            bounds = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            ids = np.array(e.ids, "<u4").tobytes()
            known.update((w, ids[4 * b:4 * c]) for w, b, c in zip(part, bounds, bounds[1:]))
        other = [w for w in words if w not in known]
        for a in range(0, len(other), 4096):
            part = other[a:a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch([text[w] for w in part], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        known.update([(w, known[w[:-1]] + known[w[-1:]]) for w in tailed])
        return known


@lru_cache(maxsize=2)
def word_ids(path: str, end_id: int) -> WordIds:
    return WordIds(path, end_id)


def pieces(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each text's ids and the end id,
    cut after every ``capacity`` ids.  Null text: the empty text, one piece of the
    end id alone.  Repeated rows and null keys keep their pieces."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        row, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(word_ids(path, end_id).encode(list(texts(batch.column(text))))):
            n = len(ids) // 4
            for a in range(0, n, capacity):
                b = min(a + capacity, n)
                row.append(i)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a:4 * b]))
                total.append(n)
        keys = batch.column(key).take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                                          [key, "start", "length", "ids_crc32", "doc_tokens"])

    return map_text(docs, [key, text], text, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long", step)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length, of those at hand, whose sum is closest to ``capacity`` from below.

    Long lengths come first.  ``reach`` has bit s set if some multiset sums to s;
    copies of a length are added by doubling (1, 2, 4, ... and the rest), and the
    state before each addition is kept to trace the best sum back.
    """
    reach, mask, steps = 1, (1 << capacity + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << copies * length & mask
            left -= copies
            copies *= 2
        if reach >> capacity:
            break
    best, out = reach.bit_length() - 1, defaultdict(int)
    for length, copies, earlier in reversed(steps):
        if not earlier >> best & 1:
            best -= copies * length
            out[length] += copies
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of places in ``lengths``, in the order they were filled."""
    at = defaultdict(list)
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], -i)):
        at[lengths[i]].append(i)
    counts = {length: len(x) for length, x in at.items()}
    windows = []
    while counts:
        first = max(counts)
        window = [at[first].pop()]
        counts[first] -= 1
        if not counts[first]:
            del counts[first]
        for length, n in fill({k: v for k, v in counts.items() if k <= capacity - first}, capacity - first).items():
            window += [at[length].pop() for _ in range(n)]
            counts[length] -= n
            if not counts[length]:
                del counts[length]
        windows.append(window)
    return windows


def _placer(columns: list[str], capacity: int, level: int, last: bool):
    """One group's rows with sequence_id (-1: its window stays open) and offset.

    Except in the last group, the emptiest windows stay open, as long as they hold
    no more than a quarter of the group's pieces: so each level has fewer."""
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__place"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
        base = level << 57 | int(pdf["__group"].iloc[0]) << 29
        open_, may = [], 0 if last else len(pdf) // 4
        for k, window in enumerate(pack_group(lengths, capacity)):
            used = 0
            for i in window:
                offset[i] = used
                used += lengths[i]
            sequence[window] = base | k
            if used < capacity:
                open_.append((used, k, window))
        for _, _, window in sorted(open_):
            may -= len(window)
            if may < 0:
                break
            sequence[window], offset[window] = -1, 0
        out = pdf[columns].copy()
        out["sequence_id"], out["offset"], out["__place"] = sequence, offset, pdf["__place"]
        return out
    return place


def pack(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces (rows with a ``length`` up to ``capacity``).

    Each row is placed once; a sequence is gapless from 0.  Which pieces meet is a
    pure function of the checkpointed pieces.  A sequence id is made of level (5
    bits), group (28 bits) and place in the group (29 bits); a full piece is a
    sequence of its own, above those.  Empty input: no rows.
    """
    ensure_checkpoint_dir(cut.sparkSession)
    columns = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    # dealt by place, not by key: repeated or null keys are spread too
    every = cut.withColumn("__place", F.monotonically_increasing_id()).checkpoint()
    zero = F.lit(0).cast("long")
    done = [every.where(F.col("length") >= capacity).select(*columns, (F.col("__place") + F.lit(1 << 62)).alias("sequence_id"), zero.alias("offset"))]
    left, level = every.where(F.col("length") < capacity), 0
    while True:
        groups = max(1, -(-left.count() // group))
        dealt = left.withColumn("__group", F.pmod(F.xxhash64("__place", F.lit(level)), F.lit(groups)))
        placed = dealt.groupBy("__group").applyInPandas(_placer(columns, capacity, level, groups == 1), schema + ", __place long").checkpoint()
        done.append(placed.where("sequence_id >= 0").drop("__place"))
        if groups == 1:
            break
        left, level = placed.where("sequence_id < 0").drop("sequence_id", "offset"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
