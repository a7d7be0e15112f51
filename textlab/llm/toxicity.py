"""Toxicity by subword bags: averaged n-gram embeddings into a linear softmax.

A word's vector is the average of the embeddings of its character n-grams
(hashed), so a misspelling shares most of its vector with the word it bends.  A
linear softmax turns a vector into two class scores; embeddings and softmax are
trained jointly, in numpy.  Labels mark whole documents but one word can make a
document toxic, so training alternates: the current model picks each toxic
document's most toxic words and each clean document's most suspicious ones, and
learns from those.  A document's score is a logistic of its most toxic word.

At scoring time only the difference of the two classes' scores per n-gram
matters: one number for each hash bucket, averaged over each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_text, text_view

BUCKETS = 1 << 17
NGRAMS = (3, 5, 7)
DIMS = 8
#: The fit takes this many labelled documents of each class at most (those first
#: in hash order), and of them those up to this many characters.
SAMPLE, SAMPLE_CHARS = 3000, 1 << 15
ROUNDS, EPOCHS = 3, 6


def _byte_classes() -> np.ndarray:
    """Lower case for A-Z; 0 for ASCII white space, control and punctuation."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[b for b in range(128) if not chr(b).isalnum() and chr(b) not in "'*@$_-+"]] = 0
    return table


CLASSES = _byte_classes()


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes between two zeros, first and end place of every word)."""
    folded = np.zeros(len(data) + 2, np.uint8)
    folded[1:-1] = CLASSES[data]
    inside = folded > 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    return folded, first, end


def ngrams(folded: np.ndarray):
    """For each length: (bucket at every place, whether the n-gram lies in one word with its borders)."""
    zero = np.concatenate([[0], np.cumsum(folded == 0)])
    hashed, have = np.zeros(len(folded), np.uint32), 0
    for n in NGRAMS:
        while have < n:
            m = len(folded) - have
            hashed = hashed[:max(m, 0)] * np.uint32(0x01000193) + folded[have:] + np.uint32(1)
            have += 1
        m = len(hashed)
        if m <= 0:
            return
        mixed = hashed ^ hashed >> np.uint32(15)
        mixed = mixed * np.uint32(0x2C1B3C6D) + np.uint32(n)
        bucket = (mixed >> np.uint32(9)) & np.uint32(BUCKETS - 1)
        # no zero strictly inside: only the first and the last place may be borders
        yield n, bucket, zero[n - 1:n - 1 + m] - zero[1:m + 1] == 0


def word_bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, one word after the other, and their number."""
    folded, first, end = words_of(np.frombuffer(b" ".join(words), np.uint8))
    assert len(first) == len(words)
    owner_of = np.searchsorted(end, np.arange(len(folded)), "left")
    buckets, owners = [], []
    for n, bucket, ok in ngrams(folded):
        at = np.flatnonzero(ok)
        owner = owner_of[at + 1]  # the second place lies in the word (or is its end)
        buckets.append(bucket[at])
        owners.append(np.minimum(owner, len(words) - 1))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return bucket[order].astype(np.int32), counts


def _bags_in_parts(words: list[bytes], part: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    bags = [word_bags(words[a:a + part]) for a in range(0, len(words), part)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    return np.concatenate([b for b, _ in bags]), np.concatenate([c for _, c in bags])


@dataclass
class Model:
    """``weight``: per bucket, the toxic class's score less the clean one's."""
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, folded, first, end) -> np.ndarray:
        total, count = np.zeros(len(folded), np.float32), np.zeros(len(folded), np.float32)
        for n, bucket, ok in ngrams(folded):
            total[1:len(ok) + 1][: len(folded) - 1] += np.where(ok, self.weight[bucket], np.float32(0))[: len(folded) - 1]
            count[1:len(ok) + 1][: len(folded) - 1] += ok[: len(folded) - 1]
        # an n-gram that starts at the border before a word counts at the word's first place
        cuts = np.stack([first, end], 1).ravel()
        total, count = np.add.reduceat(total, cuts)[::2], np.add.reduceat(count, cuts)[::2]
        return total / np.maximum(count, 1) + self.bias

    def probability(self, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * most + self.shift, -30, 30)))


def most_toxic(model: Model, data: np.ndarray, at: np.ndarray, none: float = -20.0) -> np.ndarray:
    """Score of the most toxic word of each text (``at``: offsets; texts end with a separator)."""
    folded, first, end = words_of(data)
    out = np.full(len(at) - 1, none, np.float64)
    if len(first):
        scores = model.word_scores(folded, first, end)
        owner = np.searchsorted(at, first - 1, "right") - 1
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[start]] = np.maximum.reduceat(scores, start)
    return out


def separated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a separator after each, and their offsets."""
    data, at = text_view(column)
    n = len(at) - 1
    out = np.zeros(len(data) + n, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    return out, at + np.arange(n + 1)


class _Net:
    """Embeddings and softmax under Adagrad."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.params = [self.rng.normal(0, 0.3, (BUCKETS, DIMS)), self.rng.normal(0, 0.3, (2, DIMS)), np.zeros(2)]
        self.seen = [np.full_like(p, 1e-6) for p in self.params]

    def train(self, buckets, counts, label, weight, epochs, rate=0.2, size=2048, decay=1e-5):
        """Bags (flat buckets and their counts), classes, and weights of the rows."""
        first = np.cumsum(counts) - counts
        for _ in range(epochs):
            order = self.rng.permutation(len(counts))
            for a in range(0, len(order), size):
                rows = order[a:a + size]
                e, w, b = self.params
                n = counts[rows]
                idx = buckets[np.repeat(first[rows], n) + _within(n)]
                vec = np.add.reduceat(e[idx], np.cumsum(n) - n) / n[:, None]
                z = vec @ w.T + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                p *= (weight[rows] / weight[rows].sum())[:, None]
                back = np.repeat((p @ w) / n[:, None], n, axis=0)
                ge = np.stack([np.bincount(idx, back[:, d], BUCKETS) for d in range(DIMS)], 1)
                for k, g in enumerate((ge, p.T @ vec + decay * w, p.sum(0))):
                    self.seen[k] += g * g
                    self.params[k] = self.params[k] - rate * g / np.sqrt(self.seen[k])

    def model(self) -> Model:
        e, w, b = self.params
        return Model((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]), 1.0, 0.0)


def fit(texts: list[bytes], toxic: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS) -> Model:
    """Train on whole texts with their labels.  Without both classes: a constant model."""
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        p = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 4.0 if p == 1 else -4.0)
    types: dict[bytes, int] = {}
    docs = []
    for t in texts:
        folded, first, end = words_of(np.frombuffer(t, np.uint8))
        raw = folded.tobytes()
        docs.append(np.array(sorted({types.setdefault(raw[a:b], len(types)) for a, b in zip(first.tolist(), end.tolist())}), np.int32))
    buckets, counts = _bags_in_parts(list(types))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sizes = np.array([len(d) for d in docs])
    flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
    # how much more often, at least, toxic documents hold each n-gram: the first guess
    hits = [np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)]
    for d, y in zip(docs, toxic.tolist()):
        n = counts[d]
        hits[1 - y][np.unique(buckets[np.repeat(starts[d], n) + _within(n)])] += 1
    lift = np.log(hits[0] / toxic.sum()) - np.log(hits[1] / (toxic == 0).sum())
    sure = lift - 1.5 * np.sqrt(1 / hits[0] + 1 / hits[1])
    guess = np.maximum.reduceat(sure[buckets], starts)
    net, rng = _Net(), np.random.default_rng(3)
    held = [np.bincount(flat[toxic[owner] == y], minlength=len(types)) / (toxic == y).sum() for y in (0, 1)]
    able, clean_type = held[1] > 5 * held[0], held[0] > 0  # a word that clean documents hold as often is no reason
    for _ in range(rounds):
        is_toxic = toxic[owner] == 1
        order = np.lexsort((np.where(is_toxic & ~able[flat], np.inf, -guess[flat]), owner))
        rank, is_toxic = _within(sizes), is_toxic[order]
        positive, times = np.unique(flat[order][(rank < 1) & is_toxic & able[flat[order]]], return_counts=True)
        hard = np.unique(flat[order][(rank < 4) & ~is_toxic])
        plain = rng.choice(np.flatnonzero(clean_type), min(int(clean_type.sum()), 60_000), replace=False)
        rows = np.concatenate([positive, hard, plain])
        label = np.repeat([1, 0], [len(positive), len(hard) + len(plain)])
        weight = np.concatenate([np.sqrt(times), np.ones(len(hard) + len(plain))])
        weight[label == 1] *= 0.25 * (label == 0).sum() / weight[label == 1].sum()
        net.train(buckets[np.repeat(starts[rows], counts[rows]) + _within(counts[rows])], counts[rows], label, weight, epochs)
        model = net.model()
        guess = np.add.reduceat(model.weight[buckets].astype(np.float64), starts) / counts + model.bias
    most = np.full(len(docs), -20.0)
    np.maximum.at(most, owner, guess[flat])
    model.slope, model.shift = _logistic(most, toxic)
    return model


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic regression, by Newton steps, classes weighted alike."""
    x = np.clip(x, -20, 20)
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 0.01 * a, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -5, 5)
    return max(float(a), 0.0), float(b)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    sample: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels (0 or 1; a document with any 1 counts as 1) of at most
    ``sample`` documents a class outside the held-out part, first in hash order.
    Only their keys are ranked; null labels, keys and texts do not count, and of
    several texts under one key the first in hash order does."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    picked = [one.where(F.col("__y") == y).orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(sample) for y in (0, 1)]
    ids = picked[0].union(picked[1]).withColumnRenamed(key, "__key")  # bounded: 2 x sample keys
    rows = (docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).where(F.length("__text") <= SAMPLE_CHARS)
            .join(F.broadcast(ids), F.col("__doc") == F.col("__key")).groupBy("__doc", "__y")
            .agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("first")).collect())
    rows = sorted(rows, key=lambda r: r["__doc"])
    return [r["first"]["__text"].encode() for r in rows], np.array([r["__y"] for r in rows], np.int64)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text, 0 to 1.  Null and empty texts, and texts
    without a word, get the score of a text with nothing toxic.  Rows stay one to
    one; other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        data, at = separated(batch.column(text))
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.probability(most_toxic(model, data, at)))], [key, "score"])

    return map_text(docs, [key, text], text, f"`{key}` {kind}, score double", step)
