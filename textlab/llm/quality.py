"""Graded quality by ordinal cumulative-link regression on hashed text.

One weight per hashed feature gives a text a position s on a scale; ordered
thresholds cut the scale into grades: P(grade >= j) = logistic(s - t_j).  The
weights are shared by all grades.  A text's features are its byte trigrams, and
per word its shape next to the shape before and whether it repeats the word
before; s is the mean weight over each family, so long and short texts compare.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_text, texts

#: Buckets of each of the two families.
BUCKETS = 1 << 16
#: The fit takes this many rated documents of each grade at most (those first in
#: hash order), and of them those up to this many characters.
SAMPLE, SAMPLE_CHARS = 2000, 1 << 15
EPOCHS, RATE, DECAY, SCALE = 30, 0.05, 1e-4, 30.0
#: Least probability of a grade of 1 or more that a kept document has.
KEEP_TAIL = 0.5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte -> class (space, lower, upper, digit, beyond ASCII, or the character itself); byte -> white space."""
    kind = np.arange(256, dtype=np.uint32) + 8
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 3, 1
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    kind[space] = 0
    return kind, space


KIND, SPACE = _tables()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x7FEB352D)
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x846CA68B)
    return (x ^ x >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams and of the words of one text (either may be empty)."""
    data = np.frombuffer(text, np.uint8)
    wide = data.astype(np.uint32)
    grams = _mix(wide[:-2] * np.uint32(65536) + wide[1:-1] * np.uint32(256) + wide[2:]) if len(data) > 2 else np.zeros(0, np.uint32)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return grams, np.zeros(0, np.uint32)
    kind = KIND[data]
    length = (end - first).astype(np.uint32)
    shape = kind[first] + kind[end - 1] * np.uint32(256) + np.minimum(length, 12) * np.uint32(65536)
    order = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([[0], first[1:], [len(data)]])))
    word = np.add.reduceat(np.where(inside[1:-1], wide * (order.astype(np.uint32) * np.uint32(2654435761) | np.uint32(1)), np.uint32(0)), first)
    same = np.concatenate([[False], word[1:] == word[:-1]])
    before = np.concatenate([[np.uint32(0)], shape[:-1]])
    return grams, np.concatenate([_mix(shape + np.uint32(1)), _mix(shape * np.uint32(31) + before * np.uint32(131071) + np.uint32(2)),
                                  _mix(np.uint32(3) + same.astype(np.uint32))])


@dataclass
class Model:
    """weights: of both families, one after the other; cuts: ordered thresholds."""
    weights: np.ndarray
    cuts: np.ndarray

    def position(self, text: bytes) -> float:
        grams, words = features(text)
        s = 0.0
        if len(grams):
            s += float(self.weights[grams].mean(dtype=np.float64))
        if len(words):
            s += float(self.weights[words + np.uint32(BUCKETS)].sum(dtype=np.float64)) / (len(words) / 3)
        return s * SCALE

    def tails(self, position: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... (one column each)."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(position, float)[:, None] - self.cuts, -30, 30)))


def fit(sample: tuple[list[bytes], np.ndarray], grades: int = 3, epochs: int = EPOCHS) -> Model:
    """Adam on the log-likelihood of the grades (0 .. grades-1).  No rows: every
    text gets the middle of the scale, and is kept."""
    docs, y = sample
    y = np.asarray(y, np.int64)
    if not len(y):
        return Model(np.zeros(2 * BUCKETS, np.float32), np.linspace(-1, 1, grades - 1) - 2)
    idx, val, size = [], [], []
    for t in docs:
        grams, words = features(t)
        both, n = np.unique(np.concatenate([grams, words + np.uint32(BUCKETS)]).astype(np.int64), return_counts=True)
        idx.append(both.astype(np.int32))
        val.append((n / np.where(both < BUCKETS, max(len(grams), 1), max(len(words), 1) / 3) * SCALE).astype(np.float32))
        size.append(len(both))
    size, flat, value = np.array(size), np.concatenate(idx), np.concatenate(val)
    first = np.cumsum(size) - size
    share = np.bincount(y, minlength=grades) / len(y)
    weight = 1 / np.maximum(share[y] * (share > 0).sum(), 1e-9)  # grades count alike
    w = np.zeros(2 * BUCKETS)
    cut = np.array([-1.0, *[np.log(1.0)] * (grades - 2)])  # first threshold, then logs of the gaps
    m, v, step, rng = [np.zeros_like(w), np.zeros_like(cut)], [np.zeros_like(w), np.zeros_like(cut)], 0, np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 128):
            rows = order[a:a + 128]
            n = size[rows]
            at = np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(np.arange(len(rows)), n)
            s = np.bincount(owner, w[flat[at]] * value[at], len(rows))
            t = np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))])
            up = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -30, 30)))  # P(grade >= j)
            full = np.concatenate([np.ones((len(rows), 1)), up, np.zeros((len(rows), 1))], 1)
            slope = full * (1 - full)
            k, r = y[rows], np.arange(len(rows))
            p = np.maximum(full[r, k] - full[r, k + 1], 1e-9)
            c = weight[rows] / len(rows) / p
            gs = -c * (slope[r, k] - slope[r, k + 1])
            gt = np.zeros((len(rows), grades + 1))
            gt[r, k] += c * slope[r, k]
            gt[r, k + 1] -= c * slope[r, k + 1]
            gt = gt[:, 1:-1].sum(0)
            gcut = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(cut[j]) for j in range(1, grades - 1)]])
            gw = np.bincount(flat[at], gs[owner] * value[at], len(w)) + DECAY * w
            step += 1
            for i, (x, g) in enumerate(((w, gw), (cut, gcut))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                x -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-6)
    return Model(w.astype(np.float32), np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))]))


def grade(quality, toxic):
    """Graded rating of a labelled document: 0 poor; 1 good but toxic; 2 good."""
    return F.when(quality == 0, 0).when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2)


def graded_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, text, grade) of at most ``sample`` rated documents a grade, first in hash order.

    A document with several ratings has its lowest; of several texts under one key
    the first in hash order counts.  Null keys, texts and qualities do not count.
    Only keys are ranked."""
    rated = (labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col(key).alias("__key")).agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("__grade")))
    picked = [rated.where(F.col("__grade") == g).orderBy(F.xxhash64("__key", F.lit(23)), "__key").limit(sample) for g in (0, 1, 2)]
    ids = picked[0].union(picked[1]).union(picked[2])  # bounded: 3 x sample keys
    rows = (docs.select(F.col(key).alias("__doc"), F.col(text).alias("__text")).where(F.length("__text") <= SAMPLE_CHARS)
            .join(F.broadcast(ids), F.col("__doc") == F.col("__key")))
    return rows.groupBy("__doc", "__grade").agg(F.min(F.struct(F.xxhash64("__text"), "__text")).alias("__first")).select(
        F.col("__doc").alias("key"), F.col("__first.__text").alias("text"), F.col("__grade").alias("grade"))


def fit_rows(rows: DataFrame, grades: int = 3, epochs: int = EPOCHS) -> Model:
    """``fit`` on the rows of ``graded_rows``, in one task; only the model reaches the driver."""
    def run(batches):
        held = sorted(((r["key"], r["text"], r["grade"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        model = fit(([t.encode() for _, t, _ in held], np.array([g for _, _, g in held], np.int64)), grades, epochs)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype("<f4").tobytes()], "cuts": [model.cuts.tolist()]},
                                         schema=pa.schema([("weights", pa.binary()), ("cuts", pa.list_(pa.float64()))]))

    found = rows.repartition(1).mapInArrow(run, "weights binary, cuts array<double>").collect()  # 3 x sample rows, one model
    return Model(np.frombuffer(found[0]["weights"], "<f4"), np.array(found[0]["cuts"])) if found else fit(([], []), grades)


def _rated(model: Model, column) -> np.ndarray:
    return model.tails(np.array([model.position(t) for t in texts(column)]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected_grade, tail_probability): the mean grade, and the probability
    of a grade of 1 or more.  Null texts count as empty; a text without features
    stands at 0 of the scale.  Rows stay one to one; other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batch):
        tails = _rated(model, batch.column(text))
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(tails.sum(1)), pa.array(tails[:, 0])],
                                          [key, "expected_grade", "tail_probability"])

    return map_text(docs, [key, text], text, f"`{key}` {kind}, expected_grade double, tail_probability double", step)


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = KEEP_TAIL) -> DataFrame:
    """The rows of ``docs`` whose tail probability reaches ``least``, all columns as they are."""
    schema = docs.schema

    def step(batch):
        return batch.filter(pa.array(_rated(model, batch.column(text))[:, 0] >= least))

    return map_text(docs, docs.columns, text, schema, step)
