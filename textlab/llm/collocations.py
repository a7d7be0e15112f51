"""Phrase collocations by multikey quicksort of suffix pointers.

Every word starts a suffix, which counts up to ``max_words`` words or to the end of
its piece.  A three-way partition by the first word leaves the suffixes that share
it side by side; the equal part goes on with the second word, and so on to the
maximum depth.  The sizes of the equal parts are the counts of all phrases, and a
part that is smaller than the least count is abandoned with all that is in it.

Suffixes are routed over the cluster by language and leading words, so each part
is whole in one place.  Before, every step of a task makes its suffixes distinct, with
weights, and bundles those that go to one place.  Where both leading words are among the hot ones (each more than one of
``HOT`` of all words, so less than ``HOT`` words), the third is routed by too, and the
sizes of the two-word parts are added up afterwards.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_text, stored, texts

#: Fixed value: characters that end a piece (of words set apart by spaces and tabs).
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A word is hot if it makes up more than one of so many words.
HOT = 1000
#: Words whose suffixes are sorted at once, about.
PART_WORDS = 500_000
#: Bytes of text whose suffixes are made distinct at once.
STEP_BYTES = 4 << 20


def _byte_kinds() -> np.ndarray:
    """Byte -> 0 in a word, 1 between words, 2 between pieces."""
    kind = np.zeros(256, np.uint8)
    kind[[9, 32]] = 1
    kind[list(PIECE_ENDS)] = 2
    return kind


KIND = _byte_kinds()


def words_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(words, piece number of each word, text of each word) of a string column; nulls are empty."""
    docs = list(texts(column))
    folded = np.frombuffer((b"\n".join(docs) + b"\n").lower(), np.uint8)  # a piece end after each text; A-Z only
    kind = KIND[folded]
    inside = np.zeros(len(kind) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    # the words side by side, as one string column
    letters = folded[inside[1:-1]]
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    ends = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    return words, piece, np.searchsorted(ends, first, "right")


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each kind, rows of that kind); columns hold numbers from 0."""
    key = columns[0].astype(np.int64)
    for more in columns[1:]:
        size = int(more.max(initial=0)) + 1
        if int(key.max(initial=0)) + 1 > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + more
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return first, count


def _languages(column: pa.Array) -> pa.DictionaryArray:
    return pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, f): occurrences of each word of each language."""
    def step(batch):
        words, _, owner = words_of(batch.column(text))
        langs = _languages(batch.column(lang))
        language, code = langs.indices.to_numpy()[owner], words.indices.to_numpy()
        if not len(code):
            return None
        first, count = _distinct([language, code])
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(language[first])), words.dictionary.take(pa.array(code[first])), pa.array(count)],
                                          ["lang", "phrase", "f"])

    parts = map_text(docs, [lang, text], text, "lang string, phrase string, f long", step)
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _small(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Bundle:
    """Distinct suffixes with their numbers, as one compressed value: words and languages
    once, then columns of numbers (0: no word)."""

    @staticmethod
    def pack(words: list[str], langs: list[str], language, depth: list[np.ndarray], deep, count) -> bytes:
        used, code = np.unique(np.concatenate(depth), return_inverse=True)
        columns = [_small(x) for x in (language, *np.split(code + (used[0] >= 0), len(depth)), deep, count)]
        names = " ".join([words[i] for i in used.tolist() if i >= 0]).encode()  # words hold no space
        head = json.dumps([len(names), langs, [c.dtype.str for c in columns], len(count)]).encode()
        return zstandard.compress(struct.pack("<I", len(head)) + head + names + b"".join(c.tobytes() for c in columns), 1)

    @staticmethod
    def unpack(raw: bytes) -> tuple[list[str], list[str], list[np.ndarray]]:
        """(words, languages, columns); a column's word k is words[k - 1]."""
        raw = zstandard.decompress(raw)
        n = 4 + struct.unpack_from("<I", raw)[0]
        size, langs, kinds, rows = json.loads(raw[4:n])
        names, at, columns = raw[n:n + size].decode().split(" "), n + size, []
        for kind in kinds:
            columns.append(np.frombuffer(raw, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
        return names, langs, columns


def suffixes(docs: DataFrame, hot: set[str], parts: int, max_words: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """(part, bundle): the distinct suffixes of each step, dealt into ``parts`` by leading words."""
    def step(batch):
        words, piece, owner = words_of(batch.column(text))
        langs = _languages(batch.column(lang))
        code, language = words.indices.to_numpy(), langs.indices.to_numpy()[owner]
        n = len(code)
        if not n:
            return None
        depth = [code]
        for d in range(1, max_words):  # the d-th word after, or none (number 0) past the end of the piece
            after = np.zeros(n, np.int64)
            after[:n - d] = np.where(piece[d:] == piece[:n - d], code[d:] + 1, 0)[:max(n - d, 0)]
            depth.append(after)
        first, count = _distinct([language, *depth])
        language, depth = language[first], [code[first], *(x[first] - 1 for x in depth[1:])]
        named, tongues = words.dictionary.to_pylist(), langs.dictionary.to_pylist()
        digest = np.array([xxhash.xxh64_intdigest(w) for w in named] + [0], np.uint64)  # the last stands for no word
        warm = np.array([w in hot for w in named] + [False])
        deep = warm[depth[0]] & warm[depth[1]]
        route = np.array([xxhash.xxh64_intdigest(x) for x in tongues], np.uint64)[language]
        for d, word in enumerate(depth[:3]):
            mixed = (route ^ digest[word]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            route = mixed if d < 2 else np.where(deep, mixed, route)
        part = (route % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        bundles = [Bundle.pack(named, tongues, language[rows], [x[rows] for x in depth], deep[rows], count[rows]) for rows in np.split(order, head[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[order[head]]), pa.array(bundles, pa.binary())], ["part", "bundle"])

    return map_text(docs, [lang, text], text, "part long, bundle binary", step, STEP_BYTES)


def equal_parts(keys: list[np.ndarray], weight: np.ndarray, least: int, keep_from: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointer, size) of the equal parts of suffixes, by three-way quicksort.

    ``keys[d]`` numbers the word at depth d of every suffix (below 0: none).  Parts
    lighter than ``least`` are abandoned.  All open parts of one round are
    partitioned together: each by the word of its middle pointer, into less, equal
    and greater; equal parts go one word deeper.  Sizes come from depth ``keep_from`` on.
    """
    pointer = np.arange(len(weight), dtype=np.int32)
    start, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    table = np.stack([k.astype(np.int32) if int(k.max(initial=0)) < 1 << 31 else k for k in keys])
    while len(pointer):
        size = np.diff(np.concatenate([start, [len(pointer)]]))
        owner = np.repeat(np.arange(len(start), dtype=np.int32), size)
        word = table[depth[owner], pointer]
        pivot = word[start + size // 2][owner]
        side = (word > pivot).view(np.int8) + (word >= pivot)  # 0 less, 1 equal, 2 greater
        # a stable deal of each part's pointers to its three sides
        part = owner * 3 + side
        filled = np.bincount(part, minlength=3 * len(start))
        begin = np.cumsum(filled) - filled
        place = np.empty(len(pointer), np.int32)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            place[mine] = begin[part[mine]] + _order_within(part[mine])
        moved = np.empty_like(pointer)
        moved[place] = pointer
        full = np.flatnonzero(filled)
        begin, filled = begin[full], filled[full]
        total = np.add.reduceat(weight[moved], begin)
        equal, deeper = full % 3 == 1, depth[full // 3] + (full % 3 == 1)
        here = moved[begin]
        # an equal part of suffixes that have ended is no phrase
        alive = (total >= least) & ~(equal & (table[depth[full // 3], here] < 0))
        found = alive & equal
        for d in np.unique(deeper[found]):
            at = found & (deeper == d)
            if d >= keep_from:
                yield int(d), here[at], total[at]
        alive &= ~(equal & (deeper == len(keys)))
        begin, filled, depth = begin[alive], filled[alive], deeper[alive]
        pointer = moved[np.repeat(begin - (np.cumsum(filled) - filled), filled) + np.arange(filled.sum())]
        start = np.cumsum(filled) - filled


def _order_within(part: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    if not len(part):
        return part
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return np.arange(len(part)) - np.repeat(head, np.diff(np.concatenate([head, [len(part)]])))


def _part_counts(bundles: list[bytes], max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of two and more words of one part's suffixes, with the sizes of their equal parts."""
    opened = [Bundle.unpack(b) for b in bundles]
    names = pa.array([w for words, _, _ in opened for w in words], pa.string()).dictionary_encode()
    tongues = pa.array([x for _, langs, _ in opened for x in langs], pa.string()).dictionary_encode()
    columns, at_word, at_lang = [], 0, 0
    for words, langs, (language, *depth, deep, count) in opened:
        word_of = np.concatenate([[-1], names.indices[at_word:at_word + len(words)].to_numpy()]).astype(np.int32)
        lang_of = tongues.indices[at_lang:at_lang + len(langs)].to_numpy()
        columns.append([lang_of[language], *(word_of[x] for x in depth), deep, count.astype(np.int64)])
        at_word, at_lang = at_word + len(words), at_lang + len(langs)
    opened.clear()
    language, *keys, deep, weight = (np.concatenate(c) for c in zip(*columns))
    columns.clear()
    vocabulary = names.dictionary
    leading = keys[0].astype(np.int64) * (len(tongues.dictionary) + 1) + language  # the leading word, of its language
    # of two hot words, a part holds a piece only: any size counts there
    for rows_of, floors in ((np.flatnonzero(deep == 0), (least, 2)), (np.flatnonzero(deep), (1, 2))):
        for depth, pointer, size in equal_parts([k[rows_of] for k in (leading, *keys[1:])], weight[rows_of], *floors):
            at = rows_of[pointer]
            if floors[0] < least and depth > 2:  # three words are routed together: complete
                at, size = at[size >= least], size[size >= least]
            phrase = [vocabulary.take(pa.array(k[at])) for k in keys[:depth]]
            yield pa.RecordBatch.from_arrays([tongues.dictionary.take(pa.array(language[at])), pc.binary_join_element_wise(*phrase, " "),
                                              pa.array(np.full(len(at), depth, np.int32)), pa.array(size)], ["lang", "phrase", "words", "f"])


def _sorted_counts(batches: Iterator[pa.RecordBatch], max_words: int, least: int) -> Iterator[pa.RecordBatch]:
    """The parts of one task, which come one after the other, each by itself."""
    part, held = None, []
    for batch in batches:
        for p, bundle in zip(batch.column("part").to_pylist(), batch.column("bundle").to_pylist()):
            if p != part and held:
                yield from _part_counts(held, max_words, least)
                held = []
            part = p
            held.append(bundle)
    if held:
        yield from _part_counts(held, max_words, least)


def phrase_counts(docs: DataFrame, words: DataFrame, max_words: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, words, f): phrases of 2 to ``max_words`` words that occur ``least`` times or more.

    ``words``: the (stored) ``word_counts`` of all documents."""
    total = words.agg(F.sum("f")).first()[0] or 0
    hot = {r["phrase"] for r in words.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") * HOT > total).select("phrase").collect()}  # below HOT words
    spark = docs.sparkSession
    # several parts a task, which holds one at a time; every task has as many
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * max(4, -(-total // (PART_WORDS * tasks)))
    dealt = suffixes(docs, hot, parts, max_words, lang, text)
    dealt = dealt.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
    found = dealt.mapInArrow(lambda batches: _sorted_counts(batches, max_words, least), "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, cover: int = 50,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and cut at ``PIECE_ENDS`` and then at spaces and tabs; null
    texts are empty, a null language is ``und``.  a: occurrences of the phrase; l and r:
    of what is before and after its weakest cut (the first of equal ones); score:
    1000000 a a / (l r), rounded down.  A phrase inside a longer candidate that has
    ``cover`` per cent of its occurrences or more is dropped.  Order: score and a
    descending, then the phrase.  Repeated rows count each time; other columns are not
    read.  No documents, or no phrase that is frequent enough: no rows.
    """
    words = stored(word_counts(docs, lang, text), "words")
    phrases = stored(phrase_counts(docs, words, max_words, least, lang, text), "phrases")
    counts = stored(words.where(F.col("f") >= least).union(phrases.select("lang", "phrase", "f")), "phrase-counts")
    split = F.split("phrase", " ")
    cut = phrases.select("lang", "phrase", "f", split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    both = (cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    scored = both.withColumn("up", a * a * million).withColumn("down", l * r).withColumn("score", F.expr("up div down"))
    weakest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where("words > 2").select("lang", F.col("f").alias("over"), split.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = longer.select("lang", "over", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", "over", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = weakest.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.col("over") * 100 < F.col("a") * cover, F.lit(True)))
    flat = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # the first of each of 64 shares of a language, then of the language: no task ranks them all
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    flat = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = flat.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
