"""Byte-level BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of each new word.  The proposal is
the exact encoding if and only if every two neighbours are compatible: replaying
both tokens' merges backwards, no merge across their border would have come
first.  That check runs vectorised over all distinct neighbour pairs of a batch;
only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import list_column, map_text, texts
from .latin import beyond_latin, latin_words
from .remember import Remembered

NEVER = np.int64(1) << 40
#: Distinct words in one generation of a Python worker's memory.
REMEMBERED = 300_000
#: Longer words (in bytes) are merged one by one, with a heap.
LONG = 48


class Table:
    """Numbers by 64-bit key, looked up many at a time (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER + 1)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):  # each free place takes one of those that want it
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], at[~placed] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, ``NEVER + 1`` for keys that are not there."""
        at = self._home(keys)
        off = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(off):
            at[off] = at[off] + 1 & (1 << self.bits) - 1
            there = self.keys[at[off]]
            off = off[(there != keys[off]) & (there >= 0)]
        return np.where(self.keys[at] == keys, self.values[at], NEVER + 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merges and memory of one tokenizer file (byte-level BPE, no normaliser)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = [b""] * size
        for name, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in name)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)
        keys, ranks, self.merge = [], [], {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            keys.append(x << 20 | y)
            ranks.append(rank)
            self.merge[x, y] = rank, made
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = x, y, rank
        self.ranks = Table(np.array(keys, np.int64), np.array(ranks, np.int64))
        self.made = np.array([self.merge[k >> 20, k & 0xFFFFF][1] for k in keys], np.int64)  # by rank
        self.byte_id = {v[0]: i for i, v in enumerate(self.bytes) if len(v) == 1 and self.born[i] < 0}
        made = np.flatnonzero(self.born >= 0)
        # a token that its own letters do not merge into is never part of an encoding
        own = self.compatible(self.left[made], self.right[made], self.born[made])
        self._build_trie([*self.byte_id.values(), *made[own].tolist()])
        names = "|".join(map(regex.escape, self.special))
        self.split_special = regex.compile(f"({names})").split if names else None
        self.first_id = np.array([self.byte_id[b] for b in range(256)], np.int64)
        self.memory = Remembered(self.learn, REMEMBERED)
        self.path, self._library = path, None
        size = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(size) - size, size

    def _build_trie(self, ids: list[int]) -> None:
        step, token = {}, [-1]
        for i in ids:
            node = 0
            for b in self.bytes[i]:
                node = step.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.step = Table(np.fromiter(step.keys(), np.int64), np.fromiter(step.values(), np.int64))
        self.token = np.array(token, np.int64)

    def compatible(self, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: whether merging keeps them apart.

        Time runs backwards.  ``x`` and ``y`` are the pieces at the border, each
        with the rank of the merge that ends it; a merge of the two that comes
        earlier would have joined them.  Of equal merges the left one is first.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        x_ends = np.full(len(x), NEVER) if before is None else before.astype(np.int64)
        y_ends = x_ends.copy() if before is None else before.astype(np.int64) - 1
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            rank = self.ranks.get(x[live] << 20 | y[live])
            joined = (rank < x_ends[live]) & (rank <= y_ends[live])
            good[live[joined]] = False
            bx, by = self.born[x[live]], self.born[y[live]]
            live, bx, by = (v[~joined & ((bx >= 0) | (by >= 0))] for v in (live, bx, by))
            undo_x = bx > by
            i, j = live[undo_x], live[~undo_x]
            x_ends[i], x[i] = bx[undo_x], self.right[x[i]]
            y_ends[j], y[j] = by[~undo_x], self.left[y[j]]
        return good

    def greedy(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, owners): the longest match again and again in each word data[first:end].

        All words walk the trie together, each from where its last match ended."""
        word = np.flatnonzero(end > first)
        start = first[word]
        at, node = start.copy(), np.zeros(len(word), np.int64)
        best, stop = np.full(len(word), -1), start.copy()
        out, owners, places = [], [], []
        while len(word):
            inside = at < end[word]
            next_node = np.full(len(word), NEVER + 1)
            next_node[inside] = self.step.get(node[inside] << 8 | data[at[inside]])
            goes = next_node <= NEVER
            node, at = np.where(goes, next_node, 0), at + 1
            token = self.token[node]
            hit = goes & (token >= 0)
            best, stop = np.where(hit, token, best), np.where(hit, at, stop)
            ends = np.flatnonzero(~goes)
            if len(ends):
                out.append(best[ends])
                owners.append(word[ends])
                places.append(stop[ends])
                at[ends], best[ends] = stop[ends], -1
                stay = goes | (stop < end[word])
                if not stay.all():
                    word, at, node, best, stop = (v[stay] for v in (word, at, node, best, stop))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, owner, place = (np.concatenate(v) for v in (out, owners, places))
        order = np.argsort(place, kind="stable")  # words lie in the order of their places
        return tokens[order], owner[order]

    def merged(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, owners): exact merging of all the words together, one merge a round in each."""
        size = end - first
        owner = np.repeat(np.arange(len(first)), size)
        ids = self.first_id[data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER + 1)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.ranks.get(ids[inner] << 20 | ids[inner + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, heads)
            low_of = np.repeat(low, np.diff(np.concatenate([heads, [len(ids)]])))
            over = low_of > NEVER
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
            place = np.flatnonzero((rank == low_of) & ~over)
            place = place[np.concatenate([[True], owner[place][1:] != owner[place][:-1]])[:len(place)]]  # the leftmost in each word
            ids[place] = self.made[rank[place]]
            over[place + 1] = True
            ids, owner = ids[~over], owner[~over]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def exact(self, word: bytes) -> list[int]:
        """Merges in the order of their ranks, of equal ones the leftmost first."""
        ids = [self.byte_id[b] for b in word]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := self.merge.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(int32 tokens of all words, bounds of each): speculate on every word,
        verify all neighbours at once, and merge the failing words."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        first = end - size
        tokens, owner = self.greedy(data, first, end)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inner] << 20 | tokens[inner + 1], return_inverse=True)
        bad = np.unique(owner[inner[~self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]]])
        fails = np.zeros(len(words), bool)
        fails[bad] = True
        short, long = bad[size[bad] <= LONG], bad[size[bad] > LONG]
        more, more_owner = self.merged(data, first[short], end[short])
        by_heap = [self.exact(words[i]) for i in long.tolist()]
        stay = ~fails[owner]
        tokens = np.concatenate([tokens[stay], more, np.array([t for ids in by_heap for t in ids], np.int64)])
        owner = np.concatenate([owner[stay], short[more_owner], np.repeat(long, [len(ids) for ids in by_heap])])
        order = np.argsort(owner, kind="stable")
        return tokens[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.split_special and "<|" in text:
            return [w for p in self.split_special(text) if p for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not beyond_latin(text):
            return latin_words(text)
        # other scripts: the library's own tables of letters and digits
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def learn(self, words: set[str]):
        """(word, ids) of new words; no ordinary word spells a special token."""
        plain = [w for w in words if w not in self.special]
        tokens, bounds = self.encode_words([w.encode() for w in plain])
        blob, bounds = tokens.tobytes(), (bounds * 4).tolist()
        yield from ((w, blob[a:b]) for w, a, b in zip(plain, bounds, bounds[1:]))
        yield from ((w, np.array([self.special[w]], np.int32).tobytes()) for w in words if w in self.special)

    def encode(self, docs: list[str]) -> list[bytes]:
        """int32 ids of each text."""
        cut = [self.words(d) for d in docs]
        get = self.memory.of(cut).__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        data, first, size = self.spelled
        n = size[ids]
        at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return data[at].tobytes().decode("utf-8", "replace")


def decimals(ids: np.ndarray) -> bytes:
    """Numbers below a million as decimal text, joined by commas."""
    digits = np.full((len(ids), 7), ord(","), np.uint8)
    for k in range(6):
        digits[:, k] = ids // 10 ** (5 - k) % 10 + ord("0")
    shown = np.ones(digits.shape, bool)
    for k in range(5):
        shown[:, k] = ids >= 10 ** (5 - k)
    return digits[shown].tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text, as the tokenizers library gives
    them without special tokens added; strings of special tokens in a text are
    those tokens.  Null text: the empty text, no ids.  Rows stay one to one,
    repeated or null keys too; other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        ids = codec(path).encode([t.decode() for t in texts(batch.column(text))])
        flat = np.frombuffer(b"".join(ids), np.int32)
        return pa.RecordBatch.from_arrays([batch.column(key), list_column(flat, [len(i) // 4 for i in ids])], [key, "ids"])

    return map_text(docs, [key, text], text, f"`{key}` {kind}, ids array<int>", step)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids): the tokens' bytes, joined and read as UTF-8 with
    replacement characters for what is not valid.  Null ids: the empty text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            for a in range(0, batch.num_rows, 256):
                part = lists.slice(a, 256)
                out = [codec(path).decode(row.values.to_numpy() if row.is_valid else np.zeros(0, np.int64)) for row in part]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, 256), pa.array(out, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids
    decoded again, with the hashes of the decimal ids (joined by commas) and of the
    decoded text.  Rows as in ``encode``; only the hashes leave the task."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        own = codec(path)
        ids = [np.frombuffer(i, np.int32) for i in own.encode([t.decode() for t in texts(batch.column(text))])]
        return pa.RecordBatch.from_arrays([
            batch.column(key), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(decimals(i)).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids])], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_text(docs, [key, text], text, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", step)
