"""Benchmark decontamination by SimHash windows.

For a benchmark item of L words every window of L words of a document is a candidate. Windows and
items get a SimHash of `BITS` bits over their five-word shingles. Fingerprints are cut into blocks of
16 bits; two fingerprints within `RADIUS` differ in some block by at most `NEAR` bits, so looking up
every neighbour of every block value finds all of them. What is found is verified by the exact
weighted similarity (each shingle counts as often as it occurs): least over greatest weights, 0.8 or
more. In a fingerprint the second and later occurrences of a shingle vote as elements of their own, so
that fingerprints too differ by weighted similarity. Windows whose shingles cannot reach 0.8 with any item of their length, by count alone, are left
out before: that loses nothing. Two texts of similarity 0.8 differ in 39 of 256 bits on average
(deviation 6), so the radius of 63 leaves out less than one in 10,000 of them.

The benchmark is taken in blocks of `ITEMS` items, each held by every task; documents are only read."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .texts import SHINGLE, Powers, BASE, chunks, mix, raw, shingle_hashes, word_hashes

BITS, NEAR = 256, 3
BLOCKS = BITS // 16
RADIUS = BLOCKS * (NEAR + 1) - 1
LEAST = 0.8
ITEMS = 20_000
LUT = 1 << 22

MASKS = np.array([sum(1 << b for b in chosen) for k in range(NEAR + 1) for chosen in combinations(range(16), k)], "uint16")


def simhash(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BLOCKS) uint16: the fingerprints of `n` multisets of shingles."""
    out = np.zeros((n, BITS // 8), "uint8")
    for k in range(BITS // 64):
        bits = np.unpackbits(mix(shingles + np.uint64((k + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)).view("uint8").reshape(-1, 8), axis=1)
        votes = np.zeros((n, 64), "int32")
        np.add.at(votes, owner, bits.astype("int32") * 2 - 1)
        out[:, 8 * k:8 * k + 8] = np.packbits(votes > 0, axis=1)
    return out.view("uint16")


def occurrences(windows: np.ndarray) -> np.ndarray:
    """`windows` (one a row) with the second, third, ... occurrence of a value in its row hashed apart."""
    order = np.argsort(windows, axis=1, kind="stable")
    values = np.take_along_axis(windows, order, 1)
    fresh = np.ones(values.shape, bool)
    fresh[:, 1:] = values[:, 1:] != values[:, :-1]
    if fresh.all():
        return windows
    places = np.arange(values.shape[1])
    nth = (places - np.maximum.accumulate(np.where(fresh, places, 0), axis=1)).astype("uint64")
    out = np.empty_like(windows)
    np.put_along_axis(out, order, np.where(fresh, values, mix(values + nth * BASE)), 1)
    return out


class Index:
    """Fingerprints of items of one length, by the value of each block."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.order = [np.argsort(prints[:, b], kind="stable") for b in range(BLOCKS)]
        self.values = [prints[o, b] for b, o in enumerate(self.order)]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(print number, item number) of all pairs within RADIUS."""
        found = []
        for b in range(BLOCKS):
            wanted = prints[:, b][:, None] ^ MASKS[None, :]
            low = np.searchsorted(self.values[b], wanted, "left")
            high = np.searchsorted(self.values[b], wanted, "right")
            rows, _ = np.nonzero(high > low)
            low, sizes = low[high > low], (high - low)[high > low]
            places = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found.append(np.repeat(rows, sizes) * len(self.prints) + self.order[b][places])
        pairs = np.unique(np.concatenate(found))
        left, right = pairs // len(self.prints), pairs % len(self.prints)
        far = np.bitwise_count(prints[left] ^ self.prints[right]).sum(axis=1)
        return left[far <= RADIUS], right[far <= RADIUS]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(where[:len(a)], minlength=len(values))
    y = np.bincount(where[len(a):], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


class Benchmark:
    """What a task needs of a block of items: shingles by length of the item, and their indexes."""

    def __init__(self, texts: list[str]):
        data, offsets = raw(pa.array(texts, pa.string()))
        words, first = word_hashes(data, offsets, Powers(BASE))
        hashes, owner, _ = shingle_hashes(words, first)
        counts = np.diff(first)
        self.shingles = np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))
        self.known = np.unique(hashes)
        self.lut = np.zeros(LUT, bool)
        self.lut[hashes % np.uint64(LUT)] = True
        self.by_length = {}
        for length in np.unique(counts[counts > 0]).tolist():
            items = np.flatnonzero(counts == length)
            own = np.isin(owner, items)
            size = max(1, length - SHINGLE + 1)
            votes = occurrences(hashes[own].reshape(len(items), size))
            prints = simhash(votes.ravel(), np.repeat(np.arange(len(items)), size), len(items))
            self.by_length[length] = items, np.unique(hashes[own]), Index(prints)

    def find(self, hashes: np.ndarray, n_words: int) -> Iterator[tuple[int, int, float]]:
        """(item number, first word, similarity) of the best window for each item that a text holds;
        `hashes` are the text's shingles in order."""
        found = hashes[self.lut[hashes % np.uint64(LUT)]]
        for length, (items, known, index) in self.by_length.items():
            if not np.isin(found, known).any():
                continue
            size = max(1, length - SHINGLE + 1)
            if (length < SHINGLE) != (n_words < SHINGLE) or len(hashes) < size:
                continue                       # an item below five words equals a whole text or nothing
            hit = np.concatenate([[0], np.cumsum(np.isin(hashes, known))])
            # least / greatest >= 0.8 needs 0.8 of the item's shingles in the window
            starts = np.flatnonzero(hit[size:] - hit[:-size] >= LEAST * size - 1e-9)
            for some in np.array_split(starts, -(-len(starts) // 256)) if len(starts) else ():
                windows = hashes[some[:, None] + np.arange(size)]
                prints = simhash(occurrences(windows).ravel(), np.repeat(np.arange(len(some)), size), len(some))
                best: dict[int, tuple[float, int]] = {}
                for w, i in zip(*index.within(prints)):
                    item = int(items[i])
                    best[item] = max(best.get(item, (0.0, 0)), (similarity(windows[w], self.shingles[item]), -int(some[w])))
                for item, (alike, at) in best.items():
                    if alike >= LEAST - 1e-12:
                        yield item, -at, alike


def contaminated(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None,
                 block: int = ITEMS) -> DataFrame:
    """(keep..., item_id, first_word, similarity): the best window of each document row for each item
    it holds. `keep` are columns of documents (doc_id by default).

    Null and empty texts hold nothing, null and empty items are held by nothing. An item of fewer
    than five words is held by a document of the same words and nothing else. Repeated items and
    repeated rows give rows of their own; equal item texts are searched once."""
    keep = keep or ["doc_id"]
    item_type = benchmark.schema["item_id"].dataType
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    blocks = max(1, -(-items.count() // block))
    fields = [documents.schema[c] for c in keep]
    schema = T.StructType([*(T.StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)),
                           T.StructField("number", T.IntegerType()), T.StructField("first_word", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])
    source = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("body"))

    def search(number: int) -> DataFrame:
        # a block of the benchmark: at most about `block` texts
        held = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).collect()
        held.sort(key=lambda r: r["text"])
        texts = [r["text"] for r in held]
        shared = documents.sparkSession.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, table = Benchmark(shared.value), Powers(BASE)
            for batch in batches:
                data, offsets = raw(batch.column(len(fields)))
                rows, found = [], []
                for a, b in chunks(offsets):
                    words, first = word_hashes(data, offsets[a:b + 1], table)
                    hashes, owner, _ = shingle_hashes(words, first)
                    maybe = np.flatnonzero(bench.lut[hashes % np.uint64(LUT)])
                    near = np.unique(owner[maybe[np.isin(hashes[maybe], bench.known)]])
                    for k in near.tolist():
                        mine = slice(*np.searchsorted(owner, [k, k + 1]))
                        for item, start, alike in bench.find(hashes[mine], int(first[k + 1] - first[k])):
                            rows.append(a + k)
                            found.append((item, start, alike))
                keys = batch.take(pa.array(rows, pa.int64())).columns[:len(fields)]
                more = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *(pa.array(m, t) for m, t in zip(more, (pa.int32(), pa.int64(), pa.float64())))], names=schema.names)

        names = documents.sparkSession.createDataFrame(
            [(k, r["ids"]) for k, r in enumerate(held)],
            T.StructType([T.StructField("number", T.IntegerType()), T.StructField("ids", T.ArrayType(item_type))]))
        return (source.mapInArrow(run, schema).join(F.broadcast(names), "number")
                .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.explode_outer("ids").alias("item_id"),
                        "first_word", "similarity"))

    return reduce(DataFrame.unionByName, [search(k) for k in range(blocks)])
