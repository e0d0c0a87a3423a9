"""Character n-grams inside word borders, vocabulary and TF-IDF.

A row's grams are counted where the row is: Spark cuts the text into words, a task
takes batches of rows, looks every distinct word's grams up once, and counts them per
row in arrays. Nothing of the texts is shuffled; only the corpus counts of `top_terms`
and the document frequencies are sums over tasks."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sizes import SMALL_ROWS, small_table

VOCABULARY = 1_000_000       # entries a vocabulary may have to be sent to all tasks
KNOWN_WORDS = 1 << 17        # words whose grams a task keeps
CELLS = 1 << 21              # (row, gram) pairs counted together; one row at least


def text_words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def word_grams(word: Column, lo: int = 2, hi: int = 4) -> Column:
    """All n-grams of ' word ' for n = lo..hi; a word shorter than n gives itself
    once, at the first such n."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    # a look-ahead takes n characters and the match moves on by one, so they overlap
    grams = F.concat(*[F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
                       for n in range(lo, hi + 1)])
    return F.when(F.length(padded) < lo, F.array(padded)).otherwise(grams)


def gram_list(word: str, lo: int = 2, hi: int = 4) -> list[str]:
    """`word_grams` of one word."""
    padded = f" {word} "
    if len(padded) < lo:
        return [padded]
    return [padded[i:i + n] for n in range(lo, hi + 1) for i in range(len(padded) - n + 1)]


class GramCounter:
    """Counts grams of rows of words. With a vocabulary, its places; without, every gram
    gets a number as it comes (`grams`)."""

    def __init__(self, ngram_range=(2, 4), vocabulary: Sequence[str] | None = None):
        self.range, self.open = ngram_range, vocabulary is None
        self.place = {} if vocabulary is None else {g: i for i, g in enumerate(vocabulary)}
        self.known: dict[str, np.ndarray] = {}

    @property
    def grams(self) -> list[str]:
        return list(self.place)

    def _word(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            grams = gram_list(word, *self.range)
            if self.open:
                found = [self.place.setdefault(g, len(self.place)) for g in grams]
            else:
                found = [self.place[g] for g in grams if g in self.place]
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = np.array(found, "int64")
        return found

    def count(self, words: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, offsets of the rows, places, counts), for pieces of bounded
        size; places rise within a row. A null is a row without words."""
        if words.null_count:
            words = words.fill_null(pa.scalar([], words.type))
        offsets = words.offsets.to_numpy().astype("int64")
        offsets = offsets - offsets[0]
        flat = words.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype("int64")
        each = [self._word(w) for w in flat.dictionary.to_pylist()]
        size = np.array([len(x) for x in each], "int64")
        start = np.cumsum(size) - size
        places = np.concatenate(each) if each else np.zeros(0, "int64")
        width = max(len(self.place), 1)
        upto = np.concatenate([[0], np.cumsum(size[code])])[offsets]      # pairs before each row
        first, n = 0, len(offsets) - 1
        while first < n:
            last = int(np.searchsorted(upto, upto[first] + CELLS, "right")) - 1
            last = min(n, max(first + 1, last), first + max(1, 2 * CELLS // width) if not self.open else n)
            own = code[offsets[first]:offsets[last]]
            many = size[own]
            inner = np.arange(many.sum()) + np.repeat(start[own] - (np.cumsum(many) - many), many)
            row = np.repeat(np.repeat(np.arange(last - first), np.diff(offsets[first:last + 1])), many)
            key = row * width + places[inner]
            if self.open:
                key, count = np.unique(key, return_counts=True)
            else:
                count = np.bincount(key, minlength=(last - first) * width)
                key = np.flatnonzero(count)
                count = count[key]
            yield first, last, np.searchsorted(key, np.arange(last - first + 1) * width), key % width, count
            first = last


def _vocabulary(table: DataFrame) -> list[str]:
    """Grams by place from (gram, idx), idx from 0 without gaps."""
    rows = table.select("idx", "gram").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"a vocabulary of more than {VOCABULARY} entries")
    return [r["gram"] for r in sorted(rows)]


def char_ngrams(df: DataFrame, text: str = "text", keys: Sequence[str] = ("id",),
                ngram_range=(2, 4)) -> DataFrame:
    """(keys, gram, tf): term counts per row; every row of `df` counts for itself."""
    kept = list(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counter = GramCounter(ngram_range)
            for first, last, offsets, place, count in counter.count(batch.column("words")):
                rows = pa.array(first + np.repeat(np.arange(last - first), np.diff(offsets)))
                yield pa.record_batch({**{c: batch.column(c).take(rows) for c in kept},
                                       "gram": pa.array(counter.grams).take(pa.array(place)) if len(place) else pa.array([], pa.string()),
                                       "tf": count.astype("int64")})

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, text_words(F.col(text)).alias("words")).mapInArrow(work, f"{kinds}gram string, tf long")


def row_vectors(df: DataFrame, vocabulary: Sequence[str], text: str = "text", keys: Sequence[str] = ("id",),
                ngram_range=(2, 4)) -> DataFrame:
    """(keys, idx array, val array): places and counts of the vocabulary's grams, a row per row of
    `df`, in the tasks that have the rows."""
    kept = list(keys)
    held = df.sparkSession.sparkContext.broadcast(list(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = GramCounter(ngram_range, held.value)
        for batch in batches:
            for first, last, offsets, place, count in counter.count(batch.column("words")):
                at = pa.array(offsets.astype("int32"))
                yield pa.record_batch({**{c: batch.column(c).slice(first, last - first) for c in kept},
                                       "idx": pa.ListArray.from_arrays(at, pa.array(place.astype("int32"))),
                                       "val": pa.ListArray.from_arrays(at, pa.array(count.astype("float64")))})

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, text_words(F.col(text)).alias("words")).mapInArrow(work, f"{kinds}idx array<int>, val array<double>")


def weighted_vectors(rows: DataFrame, idf: np.ndarray, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, idx, val): counts of `row_vectors` as TF-IDF of unit length, row by row."""
    kept = list(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val = batch.column("idx"), batch.column("val")
            offsets = val.offsets.to_numpy().astype("int64")
            offsets = offsets - offsets[0]
            weight = val.flatten().to_numpy() * idf[idx.flatten().to_numpy()]
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            size = np.sqrt(np.bincount(row, weight * weight, len(offsets) - 1))
            at = pa.array(offsets.astype("int32"))
            yield pa.record_batch({**{c: batch.column(c) for c in kept}, "idx": pa.ListArray.from_arrays(at, idx.flatten()),
                                   "val": pa.ListArray.from_arrays(at, pa.array(weight / size[row]))})

    return rows.select(*kept, "idx", "val").mapInArrow(work, rows.select(*kept, "idx", "val").schema)


def top_terms(df: DataFrame, text: str = "text", max_features: int = 5000,
              ngram_range=(2, 4)) -> DataFrame:
    """(gram, tf): the grams of highest corpus count, ties by text. Distinct words
    of the corpus are counted first, so each is expanded once."""
    words = (df.select(F.explode(text_words(F.col(text))).alias("word"))
             .groupBy("word").agg(F.count("*").alias("n")))
    grams = words.select("n", F.explode(word_grams(F.col("word"), *ngram_range)).alias("gram"))
    return (grams.groupBy("gram").agg(F.sum("n").alias("tf"))
            .orderBy(F.col("tf").desc(), "gram").limit(max_features))


def row_terms(df: DataFrame, vocabulary: DataFrame, text: str = "text",
              keys: Sequence[str] = ("id",), ngram_range=(2, 4)) -> DataFrame:
    """(keys, idx, tf) for grams of the vocabulary (gram, idx) only, without any shuffle."""
    rows = row_vectors(df, _vocabulary(vocabulary), text, keys, ngram_range)
    return rows.select(*keys, F.explode(F.arrays_zip("idx", "val")).alias("t")).select(
        *keys, "t.idx", F.col("t.val").cast("long").alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """(idx, df): rows of (keys, idx) are unique already."""
    return terms.groupBy("idx").agg(F.count("*").alias("df"))


def idf(df: Column, n) -> Column:
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1.0


def tfidf(terms: DataFrame, frequency: DataFrame, n: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, idx, weight): tf * idf with unit length per row; the frequencies
    and n come from the training rows."""
    weighted = terms.join(small_table(frequency, 10 * SMALL_ROWS), "idx").withColumn(
        "weight", F.col("tf") * idf(F.col("df"), n))
    row = Window.partitionBy(*keys)
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(row))
    return weighted.withColumn("weight", F.col("weight") / size).select(*keys, "idx", "weight")
