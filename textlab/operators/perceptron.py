"""Multilayer perceptron over sparse rows: MLlib's network, objective and optimiser, in passes.

MLlib's ``MultilayerPerceptronClassifier`` keeps every row dense, all columns wide, for the
whole fit.  Here rows are stored sparse and made dense ``STEP_ROWS`` at a time; a task holds
the weights, its gradient and one such step.  Initial weights are MLlib's for the same seed;
rows weigh as in its stacks of ``block`` rows (a partition's last stack is smaller).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from .passes import entries_of, minimise, predicted, rows_of, summed

#: Rows that are dense at one time.
STEP_ROWS = 256


def _binary(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _packed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(y, weight, idx, val): a row weighs one over the rows of its stack; entries that are 0 are left out."""
    def pack(table):
        if not table.num_rows:
            return
        rows = table.combine_chunks()
        ends, index, value = entries_of(rows.column(1).chunk(0))
        held = np.flatnonzero(value != 0)
        ends = np.searchsorted(held, ends)
        n = table.num_rows
        weight = 1.0 / np.minimum(block, n - np.arange(n) // block * block)
        yield pa.RecordBatch.from_arrays([rows.column(0).chunk(0), pa.array(weight), _binary(ends, index[held].astype(np.int32)),
                                          _binary(ends, value[held].astype(np.float64))], ["y", "weight", "idx", "val"])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        full = table.num_rows // block * block
        yield from pack(table.slice(0, full))
        rest = table.slice(full)
    if rest is not None:
        yield from pack(rest)


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of packed entries."""
    size, (_, ends, data) = np.dtype(kind).itemsize, column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1] // size
    return ends - ends[0], np.frombuffer(data, kind, ends[-1] - ends[0], ends[0] * size) if data is not None else np.zeros(0, kind)


def _dense(ends: np.ndarray, index: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(ends) - 1, width))
    out[np.repeat(np.arange(len(out)), np.diff(ends)), index] = value
    return out


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights in x out, bias) of every layer, as views of MLlib's one vector."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """The rows, each hidden layer's output, and the last layer before its softmax."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        if i < len(layers) - 1:
            with np.errstate(over="ignore"):
                z = 1.0 / (1.0 + np.exp(-z))
        out.append(z)
    return out


class Perceptron:
    """Estimator: sigmoid layers and a softmax, cross-entropy by L-BFGS."""

    def __init__(self, layers: Sequence[int], features: str = "features", label: str = "label", max_iter: int = 50, seed: int = 42, block: int = 128):
        self.layers, self.features, self.label, self.max_iter, self.seed, self.block = list(layers), features, label, max_iter, seed, block

    def initial(self, spark) -> np.ndarray:
        """MLlib's initial weights of this network and seed."""
        rows = spark.createDataFrame([(float(y), Vectors.sparse(self.layers[0], [], [])) for y in {0, self.layers[-1] - 1}], ["label", "features"])
        return MultilayerPerceptronClassifier(layers=self.layers, maxIter=0, seed=self.seed, blockSize=1).fit(rows).weights.toArray()

    def fit(self, df: DataFrame) -> PerceptronModel:
        spark, sizes, block = df.sparkSession, self.layers, self.block
        rows = rows_of(df, [F.col(self.label).cast("int").alias("__y")], self.features)
        packed = stored(rows.mapInArrow(lambda batches: _packed(batches, block), "y int, weight double, idx binary, val binary"), "packed-rows")
        at = minimise(self.initial(spark), self.max_iter)
        point = next(at)
        while True:
            state = spark.sparkContext.broadcast(point)

            def part(batches):
                weights = state.value
                gradient, loss = np.zeros(len(weights)), np.zeros(2)
                layers, into = _layers(weights, sizes), _layers(gradient, sizes)
                for batch in batches:
                    for a in range(0, batch.num_rows, STEP_ROWS):
                        own = batch.slice(a, STEP_ROWS)
                        y, weight = own.column(0).to_numpy(), own.column(1).to_numpy()
                        ends, index = _numbers(own.column(2), np.int32)
                        outs = _forward(_dense(ends, index, _numbers(own.column(3), np.float64)[1], sizes[0]), layers)
                        z = outs.pop()
                        z = z - z.max(1, keepdims=True)
                        e = np.exp(z)
                        every = e.sum(1)
                        loss += (weight * (np.log(every) - z[np.arange(len(y)), y])).sum(), weight.sum()
                        delta = e / every[:, None]
                        delta[np.arange(len(y)), y] -= 1.0
                        delta *= weight[:, None]
                        for (w, _), (dw, db), x in reversed(list(zip(layers, into, outs))):
                            dw += x.T @ delta
                            db += delta.sum(0)
                            if x is not outs[0]:
                                delta = (delta @ w.T) * x * (1.0 - x)
                return gradient, loss

            gradient, (loss, stacks) = summed(packed, part, [point.shape, (2,)])
            state.destroy()
            if not stacks:
                raise ValueError("no rows to fit")
            try:
                point = at.send((loss / stacks, gradient / stacks))
            except StopIteration as done:
                return PerceptronModel(done.value, sizes, self.features)


class PerceptronModel:
    """The class of the largest output."""

    def __init__(self, weights: np.ndarray, sizes: Sequence[int], features: str):
        self.weights, self.sizes, self.features = weights, sizes, features

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` in place of the features."""
        held, sizes = df.sparkSession.sparkContext.broadcast(self.weights), self.sizes

        def score(vectors):
            layers, out = _layers(held.value, sizes), []
            ends, index, value = entries_of(vectors)
            for a in range(0, len(vectors), STEP_ROWS):
                own = ends[a:a + STEP_ROWS + 1]
                out.append(_forward(_dense(own, index[own[0]:own[-1]], value[own[0]:own[-1]], sizes[0]), layers)[-1].argmax(1))
            return np.concatenate(out) if out else np.zeros(0)

        return predicted(df, self.features, score)
