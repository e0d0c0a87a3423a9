"""The header feature vector: TF-IDF -> SVD, manual counts, z-score.

`fit` sees training rows only; every other row, and every view, is transformed
with what was fitted."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsontext import canonical, manual_counts
from ..functions.vectors import zscore
from ..session import stored
from .ngrams import GramCounter, document_frequency, row_vectors, text_words, top_terms
from .sampling import stratified_split
from .svd import pieces, svd_apply, svd_fit

# The feature variants.
VARIANTS = {
    "full": {},
    "no_manual": {"use_manual": False},
    "canonical": {"canonicalize": True},
    "canon_no_manual": {"use_manual": False, "canonicalize": True},
}


def moments(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each place of a vector column."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    row = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select(
        "s.mean", "s.variance", "s.count").first()
    n = row["count"]
    return row["mean"].toArray(), np.sqrt(row["variance"].toArray() * (n - 1) / max(n, 1))


def array_lit(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


class Preprocessor:
    """Header features with a fit / transform border."""

    def __init__(self, svd_dim: int = 64, use_manual: bool = True, canonicalize: bool = False,
                 max_features: int = 5000, ngram_range: tuple[int, int] = (2, 4), seed: int = 42,
                 scale: bool = True, headers: str = "headers", request: str = "request"):
        self.svd_dim, self.use_manual, self.canonicalize = svd_dim, use_manual, canonicalize
        self.max_features, self.ngram_range, self.seed = max_features, ngram_range, seed
        self.scale, self.headers, self.request = scale, headers, request
        self.vocabulary: list[str] | None = None

    def _texts(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        header = canonical(self.headers) if self.canonicalize else F.col(self.headers)
        manual = manual_counts(header, self.request) if self.use_manual else []
        counts = [F.coalesce(m, F.lit(0)) for m in manual]        # a null text has nothing to count
        return df.select(*keys, header.alias("text"), F.array(*counts).cast("array<double>").alias("manual"))

    def _raw(self, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, x): SVD and manual places side by side, each row where it is."""
        kept, counter = list(keys), (self.ngram_range, self.vocabulary)
        held = texts.sparkSession.sparkContext.broadcast((self.idf, np.ascontiguousarray(self.components.T)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = GramCounter(*counter)
            weights, turn = held.value
            for batch in batches:
                for begin, _, offsets, place, count in grams.count(batch.column("words")):
                    for first, last, a in pieces(offsets, place, count, len(weights), weights):
                        x, n = a.times(turn), last - first
                        manual = batch.column("manual").slice(begin + first, n)
                        x = np.concatenate([x, manual.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)], axis=1)
                        at = pa.array(np.arange(n + 1, dtype="int32") * x.shape[1])
                        yield pa.record_batch({**{c: batch.column(c).slice(begin + first, n) for c in kept},
                                               "x": pa.ListArray.from_arrays(at, pa.array(x.ravel()))})

        kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in kept)
        words = texts.select(*kept, text_words(F.col("text")).alias("words"), "manual")
        return words.mapInArrow(work, f"{kinds}x array<double>")

    def fit(self, df: DataFrame, keys: Sequence[str] = ("id",)) -> "Preprocessor":
        texts = self._texts(df, keys)
        top = top_terms(texts, "text", self.max_features, self.ngram_range)
        self.vocabulary = sorted(r["gram"] for r in top.collect())
        carried = (*keys, "manual")
        rows = stored(row_vectors(texts, self.vocabulary, "text", carried, self.ngram_range), "terms")
        frequency = dict(document_frequency(rows.select(F.explode("idx").alias("idx"))).collect())
        n = rows.count()
        df = np.array([frequency.get(i, 0) for i in range(len(self.vocabulary))], dtype=float)
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.components, self.singular_values = svd_fit(
            rows, len(self.vocabulary), self.svd_dim, self.seed, self.idf)
        projected = svd_apply(rows, self.components, carried, self.idf)
        self.mean, self.std = moments(projected.select(F.concat("x", "manual").alias("x")), "x")
        return self

    def transform(self, df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
        """(keys, features array<float>), without a shuffle."""
        if self.vocabulary is None:
            raise RuntimeError("transform called before fit")
        raw = self._raw(self._texts(df, keys), keys)
        x = zscore("x", array_lit(self.mean), array_lit(self.std)) if self.scale else F.col("x")
        return raw.select(*keys, x.cast("array<float>").alias("features"))

    def fit_transform(self, df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
        return self.fit(df, keys).transform(df, keys)


def full_corpus_features(df: DataFrame, seed: int = 42, svd_dim: int = 64, **options) -> DataFrame:
    """Label-free features fitted on all rows."""
    return Preprocessor(svd_dim=svd_dim, seed=seed, **options).fit_transform(df)


def unscaled_features(df: DataFrame, seed: int = 42, svd_dim: int = 64, **options) -> DataFrame:
    """SVD and counts fitted on all rows, without z-score."""
    return Preprocessor(svd_dim=svd_dim, seed=seed, scale=False, **options).fit_transform(df)


def build_features(df: DataFrame, test_size: float = 0.3, seed: int = 42, **options):
    """Split first, then fit on train: (id, y, split, features) and the fitted
    preprocessor. Options are those of `Preprocessor`."""
    parts = stratified_split(df, test_size, seed)
    fitted = Preprocessor(seed=seed, **options).fit(parts.where("split = 'train'"))
    features = fitted.transform(parts)
    return parts.select("id", "y", "split").join(features, "id"), fitted
