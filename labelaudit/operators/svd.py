"""Truncated SVD of sparse rows by subspace iteration.

Each round multiplies the data by a thin matrix (width x (k + 10)) on the
executors and sums the products by Spark; only that thin matrix, whose size is
fixed by the vocabulary, reaches the driver. Of narrow rows A the small matrix
A^T A is summed once, and all rounds are products with it: one pass in place of seven."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

BATCH = 1024
DENSE_SHARE = 1 / 32         # share of the rows from which on a place is worth a dense column
CHUNK = 64
NARROW = 1024                # width up to which A^T A is summed: 8 MB in each task
OVERSAMPLE = 10
ROUNDS = 6


def _sums(owner: np.ndarray, other: np.ndarray, value: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, sums of value * source[other]) of entries sorted by owner: the j-th entries of all owners
    that have so many are added together."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    many = np.diff(np.r_[first, len(owner)])
    order = np.argsort(-many, kind="stable")
    first, many = first[order], many[order]
    out = np.zeros((len(first), source.shape[1]))
    for j, n in enumerate(np.searchsorted(-many, -np.arange(many[0]))):
        at = first[:n] + j
        out[:n] += value[at, None] * source[other[at]]
    return owner[first], out


class Piece:
    """Some sparse rows as a matrix A: places that many of the rows have as a dense block, the others as they are."""

    def __init__(self, rows: int, row: np.ndarray, place: np.ndarray, value: np.ndarray, width: int,
                 share: float = DENSE_SHARE):
        self.often = np.flatnonzero(np.bincount(place, minlength=width) > rows * share)
        number = np.full(width, -1)
        number[self.often] = np.arange(len(self.often))
        at = number[place]
        dense = at >= 0
        self.block = np.zeros((rows, len(self.often)))
        self.block[row[dense], at[dense]] = value[dense]
        self.row, self.place, self.value = row[~dense], place[~dense], value[~dense]

    def times(self, q: np.ndarray) -> np.ndarray:
        """A q."""
        y = self.block @ q[self.often]
        if len(self.row):
            rows, sums = _sums(self.row, self.place, self.value, q)
            y[rows] += sums
        return y

    def add_back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds A^T y to `total`."""
        total[self.often] += self.block.T @ y
        if len(self.row):
            order = np.argsort(self.place, kind="stable")
            places, sums = _sums(self.place[order], self.row[order], self.value[order], y)
            total[places] += sums


def pieces(offsets: np.ndarray, place: np.ndarray, value: np.ndarray, width: int, idf: np.ndarray | None = None,
           share: float = DENSE_SHARE) -> Iterator[tuple[int, int, Piece]]:
    """(first row, last row + 1, rows), BATCH at a time; places are unique within a row. With `idf` the
    values are term counts and the rows become TF-IDF rows of unit length. A `share` below 0 makes all places dense."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if idf is not None:
        value = value * idf[place]
        size = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
        value = value / np.where(size > 0, size, 1.0)[row]
    for first in range(0, len(offsets) - 1, BATCH):
        last = min(first + BATCH, len(offsets) - 1)
        own = slice(offsets[first], offsets[last])
        yield first, last, Piece(last - first, row[own] - first, place[own], value[own], width, share)


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, places, values) of the rows (idx, val) of a batch."""
    idx, val = batch.column("idx"), batch.column("val")
    offsets = idx.offsets.to_numpy().astype("int64")
    return offsets - offsets[0], idx.flatten().to_numpy(), val.flatten().to_numpy().astype(float)


def _summed(rows: DataFrame, width: int, cols: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of matrices (width x cols) to which `add` adds batch by batch."""
    chunks = -(-width // CHUNK)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((chunks * CHUNK, cols))
        for batch in batches:
            add(batch, total)
        at = pa.array(np.arange(chunks + 1, dtype="int32") * (CHUNK * cols))
        yield pa.record_batch({"chunk": pa.array(np.arange(chunks, dtype="int32")),
                               "part": pa.ListArray.from_arrays(at, pa.array(total.ravel()))})

    parts = rows.select("idx", "val").mapInArrow(part, "chunk int, part array<double>")
    sums = (parts.groupBy("chunk").agg(Summarizer.sum(array_to_vector("part")).alias("s"))
            .select("chunk", vector_to_array("s").alias("s")).toPandas().sort_values("chunk"))
    return np.concatenate([s.reshape(CHUNK, cols) for s in sums["s"]])[:width]


def _gram_product(rows: DataFrame, q: np.ndarray, idf: np.ndarray | None) -> np.ndarray:
    """A^T (A q) for the row matrix A held as (idx array, val array)."""
    width = len(q)

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, a in pieces(*_sparse(batch), width, idf):
            a.add_back(a.times(q), total)

    return _summed(rows, width, q.shape[1], add)


def _gram_matrix(rows: DataFrame, width: int, idf: np.ndarray | None) -> np.ndarray:
    """A^T A."""
    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, a in pieces(*_sparse(batch), width, idf, -1.0):
            total[:width] += a.block.T @ a.block

    return _summed(rows, width, width, add)


def svd_fit(rows: DataFrame, width: int, k: int, seed: int = 42, idf: np.ndarray | None = None,
            rounds: int = ROUNDS):
    """(components k x width, singular values k) of rows (idx, val). Signs are fixed by the largest
    entry of each component."""
    k = min(k, width)
    start = np.random.default_rng(seed).standard_normal((width, min(width, k + OVERSAMPLE)))
    q, _ = np.linalg.qr(start)
    if width <= NARROW:
        gram = _gram_matrix(rows, width, idf)
        product = lambda q: gram @ q
    else:
        product = lambda q: _gram_product(rows, q, idf)
    for _ in range(rounds):
        q, _ = np.linalg.qr(product(q))
    values, vectors = np.linalg.eigh(q.T @ product(q))
    best = np.argsort(values)[::-1][:k]
    components = (q @ vectors[:, best]).T
    largest = np.abs(components).argmax(axis=1)
    signs = np.sign(components[np.arange(len(components)), largest])
    components *= np.where(signs == 0, 1.0, signs)[:, None]
    return components, np.sqrt(np.maximum(values[best], 0.0))


def svd_apply(rows: DataFrame, components: np.ndarray, keys=("id",),
              idf: np.ndarray | None = None) -> DataFrame:
    """(keys, x array<double>): rows projected on the components."""
    turn, width, kept = np.ascontiguousarray(components.T), components.shape[1], list(keys)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, a in pieces(*_sparse(batch), width, idf):
                x = a.times(turn)
                at = pa.array(np.arange(last - first + 1, dtype="int32") * x.shape[1])
                yield pa.record_batch({**{c: batch.column(c).slice(first, last - first) for c in kept},
                                       "x": pa.ListArray.from_arrays(at, pa.array(x.ravel()))})

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*kept, "idx", "val").mapInArrow(project, f"{kinds}x array<double>")
