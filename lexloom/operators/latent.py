"""Sentence vectors learned from the texts themselves: latent semantic analysis at scale.

Sentences are rows of weighted term statistics, terms being hashed into SLOTS columns. A randomised
range finder multiplies this matrix with few random columns; its products are sums over sentences, so
tasks add them up and Spark adds up the tasks. What comes to the driver is bounded by SLOTS times the
columns, whatever the number of sentences: an orthonormal basis, from which the leading right singular
vectors follow. They map terms to vectors, and a sentence to the weighted sum of its terms'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.storage import stored

#: Hashed terms, components of a vector, random columns beyond these, passes that sharpen the range.
SLOTS, SIZE, MORE, PASSES = 1 << 15, 128, 16, 2
#: Terms of a batch that are multiplied at once, few enough to stay in a core's cache; slots whose sums are one row.
_AT_ONCE, _BLOCK = 2_000, 1024


def slots_of(words: Column, slots: int = SLOTS) -> Column:
    """The column of each word."""
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % slots).cast("int"))


class LatentModel:
    """weights: of each slot; vectors: slots times components."""

    def __init__(self, weights: np.ndarray, vectors: np.ndarray):
        self.weights, self.vectors = weights, vectors

    @cached_property
    def weighted(self) -> np.ndarray:
        return self.weights[:, None] * self.vectors

    def embed(self, lists: pa.Array) -> np.ndarray:
        return _multiplied(lists, self.weighted)


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all rows, number of each row)."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size


def _multiplied(lists: pa.Array, m: np.ndarray) -> np.ndarray:
    """The rows' terms times `m`, which has the terms' weights in it."""
    slots, size = _rows(lists)
    out, ends = np.zeros((len(size), m.shape[1])), np.concatenate(([0], np.cumsum(size)))
    row = 0
    while row < len(size):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + _AT_ONCE, "right")) - 1)
        part, full = slots[ends[row] : ends[last]], row + np.flatnonzero(size[row:last])
        if len(full):
            out[full] = np.add.reduceat(m[part], ends[full] - ends[row])
        row = last
    return out


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of the tasks' matrices, which come as rows of _BLOCK (block, x)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = 0, 0.0
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("x"), strict=True):
                total = total + np.frombuffer(x.as_buffer())
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "x"])

    out = np.zeros(shape)
    for r in parts.groupBy("block").applyInArrow(add, "block int, x binary").collect():
        part = np.frombuffer(r.x).reshape(-1, shape[1])
        out[r.block * _BLOCK : r.block * _BLOCK + len(part)] = part
    return out


def _parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(total), _BLOCK):
        if total[a : a + _BLOCK].any():
            yield pa.record_batch([pa.array([a // _BLOCK], pa.int32()), pa.array([total[a : a + _BLOCK].tobytes()], pa.binary())], names=["block", "x"])


def _back(rows: DataFrame, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The matrix, transposed, times itself times `m`; a row counts n times."""
    weighted = weights[:, None] * m

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weighted.shape)
        for b in batches:
            y = _multiplied(b.column("slots"), weighted) * b.column("n").to_numpy()[:, None]
            at, size = _rows(b.column("slots"))
            order = np.argsort(at, kind="stable")
            at, owner = at[order], np.repeat(np.arange(len(size)), size)[order]
            for a in range(0, len(at), _AT_ONCE):
                slot, first = np.unique(at[a : a + _AT_ONCE], return_index=True)
                total[slot] += np.add.reduceat(y[owner[a : a + _AT_ONCE]], first)
        yield from _parts(total * weights[:, None])

    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # a task's sums are of one size, whatever it reads
    return _summed(rows.mapInArrow(products, "block int, x binary"), m.shape)


def _gram(rows: DataFrame, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The products of the columns of the matrix times `m`, one with another; a row counts n times."""
    weighted = weights[:, None] * m

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((weighted.shape[1],) * 2)
        for b in batches:
            y = _multiplied(b.column("slots"), weighted)
            total += y.T @ (y * b.column("n").to_numpy()[:, None])
        yield from _parts(total)

    return _summed(rows.mapInArrow(products, "block int, x binary"), (m.shape[1],) * 2)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def learn(sentences: DataFrame, size: int = SIZE, slots: int = SLOTS, passes: int = PASSES, seed: int = 1) -> LatentModel:
    """A model from all sentences (sentence); null and wordless ones add nothing, repeated ones count each.

    A term's weight is the square of ln((1 + sentences) / (1 + those with it)). Components are divided by their
    singular values, or what all sentences have in common would make all of them alike. Without any
    sentence all vectors are zero, and match nothing.
    """
    cut = sentences.select(slots_of(T.words(F.coalesce("sentence", F.lit(""))), slots).alias("slots"))
    rows = stored(cut.filter(F.size("slots") > 0).groupBy("slots").agg(F.count("*").alias("n")), "latent-sentences")  # repeated ones are multiplied once
    number = rows.agg(F.sum("n")).first()[0] or 0
    counts = np.zeros(slots)
    for r in rows.select(F.explode(F.array_distinct("slots")).alias("slot"), "n").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # `slots` rows at most
        counts[r.slot] = r.n
    weights = np.log((1 + number) / (1 + counts)) ** 2
    width = min(size + MORE, slots)
    basis = np.random.default_rng(seed).normal(size=(slots, width))
    for _ in range(passes):
        basis, _ = np.linalg.qr(_back(rows, weights, basis))
    values, turn = np.linalg.eigh(_gram(rows, weights, basis))
    best = np.argsort(-values)[:size]
    strong = values[best] > 1e-9 * max(values.max(), 1e-300)  # the others are directions that no sentence has
    vectors = basis @ turn[:, best] * np.where(strong, 1 / np.sqrt(np.where(strong, values[best], 1)), 0) * np.sqrt(max(1, number))
    return LatentModel(weights, vectors)


def save(model: LatentModel, spark: SparkSession, folder: str) -> None:
    """The model as a table of slots, so that stored vectors and later ones are of the same space."""
    rows = ((k, float(w), v.tolist()) for k, (w, v) in enumerate(zip(model.weights, model.vectors, strict=True)))
    spark.createDataFrame(list(rows), "slot int, weight double, vector array<double>").coalesce(1).write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> LatentModel:
    rows = spark.read.parquet(folder).orderBy("slot").collect()  # a row for each slot
    return LatentModel(np.array([r.weight for r in rows]), np.array([r.vector for r in rows]))


def embedder(model: LatentModel, spark: SparkSession) -> Callable[[Column], Column]:
    """A Column builder of sentence vectors; the model goes to every task once."""
    shared, slots = spark.sparkContext.broadcast(model), len(model.weights)

    @F.arrow_udf("array<float>")
    def embed(lists: pa.Array) -> pa.Array:
        return _lists(shared.value.embed(lists).astype(np.float32))

    return lambda sentence: embed(slots_of(T.words(F.coalesce(sentence, F.lit(""))), slots))
