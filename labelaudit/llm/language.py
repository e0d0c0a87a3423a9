"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is its words (runs of letters, lower case), a word its character n-grams with word borders,
an n-gram one of `BUCKETS` embeddings. The mean embedding of a text goes through one linear layer.
Trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; a temperature
and a threshold for rejection are set on rows kept from the training. In prediction every n-gram's
embedding is already multiplied with the layer, and words are looked up once per chunk of texts."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .texts import mix

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
DIMS = 16
PER_LANGUAGE = 300           # documented bound: labelled rows sampled for each language
MAX_LANGUAGES = 1000         # more distinct labels than that are no languages
SNIPPET = 6                  # words of the short example each sampled document gives besides its whole
CHUNK = 1 << 20              # characters of text worked on together
LOST = 0.001                 # share of known-language examples that rejection may lose
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def subwords(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word."""
    padded = "".join(f"<{w}>" for w in vocabulary)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    sizes = np.array([len(w) + 2 for w in vocabulary], "int64")
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))    # characters to the word's end
    owners, buckets, total = [], [], np.zeros(len(codes), "uint64")
    for j in range(max(SIZES)):
        total = total[:len(codes) - j] * np.uint64(0x100000001B3) + codes[j:]
        if j + 1 in SIZES:
            inside = left[:len(total)] > j
            owners.append(owner[:len(total)][inside])
            buckets.append((mix(total[inside] + np.uint64(j)) % np.uint64(BUCKETS)).astype("int64"))
    return np.concatenate(owners), np.concatenate(buckets)


def bucket_counts(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's words."""
    count = Counter(found)
    if not count:
        return np.zeros(0, "int32"), np.zeros(0, "float32")
    owner, bucket = subwords(list(count))
    places, where = np.unique(bucket, return_inverse=True)
    return places.astype("int32"), np.bincount(where, np.array(list(count.values()))[owner]).astype("float32")


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray           # BUCKETS x languages: embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each whole text; UNKNOWN with score 0 where it has no letters."""
        counts = [Counter(words(t)) for t in texts]
        number: dict[str, int] = {}
        for c in counts:
            for w in c:
                number.setdefault(w, len(number))
        names, top = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not number or not self.languages:
            return names, top
        owner, bucket = subwords(list(number))
        k = len(self.languages)
        by_word = np.stack([np.bincount(owner, self.scores[bucket, c], len(number)) for c in range(k)], axis=1)
        grams = np.bincount(owner, minlength=len(number))
        for at, c in enumerate(counts):
            if c:
                ids = np.fromiter((number[w] for w in c), "int64", len(c))
                n = np.fromiter(c.values(), "float64", len(c))
                p = self.probabilities(n @ by_word[ids] / (n @ grams[ids]) + self.bias)
                best = int(p.argmax())
                names[at], top[at] = self.languages[best], min(1.0, float(p[best]))
        return names, top

    def rejects(self, name: Column, score: Column) -> Column:
        return (name == UNKNOWN) | (score < self.threshold)


def examples(documents: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 11) -> tuple[list[str], pd.DataFrame]:
    """The languages and a bounded sample of examples (lang, draw, idx, n): about `per_language` rows
    of each language by a hash of id and text (of equal rows one), each as its whole text and as a short run of its words."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", "lang", (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / (1 << 40)).alias("draw"))
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"column 'lang' has more than {MAX_LANGUAGES} values")
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], pd.DataFrame({"lang": [], "draw": [], "idx": [], "n": []})
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 1.2 * per_language / r["count"])])
    order = Window.partitionBy("lang").orderBy("draw")
    sample = (labelled.where(F.col("draw") < share[F.col("lang")]).dropDuplicates(["lang", "draw"])
              .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, lang, draw in zip(pdf["text"], pdf["lang"], pdf["draw"]):
                found = words(text)
                start = int(draw * 1e9) % max(1, len(found) - SNIPPET + 1)
                for part in (found, found[start:start + SNIPPET]):
                    if part:
                        out.append((lang, draw, *bucket_counts(part)))
            yield pd.DataFrame(out, columns=["lang", "draw", "idx", "n"])

    return languages, sample.select("text", "lang", "draw").mapInPandas(
        features, "lang string, draw double, idx array<int>, n array<float>").toPandas()


def train(languages: list[str], sample: pd.DataFrame, least_steps: int = 400, batch: int = 32,
          rate: float = 25.0, seed: int = 5) -> Model:
    """Softmax on mean embeddings by mini-batch gradient descent; a fifth of the documents is kept for
    the temperature and the threshold."""
    rng, k = np.random.default_rng(seed), len(languages)
    table = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype("float32")
    layer, bias = np.zeros((DIMS, k), "float32"), np.zeros(k, "float32")
    layer += rng.normal(0, 0.3, layer.shape).astype("float32")
    if not k or not len(sample):
        return Model([], np.zeros((BUCKETS, 0), "float32"), bias)
    sample = sample.sort_values(["lang", "draw"], kind="stable").reset_index(drop=True)
    target = np.array([languages.index(x) for x in sample["lang"]])
    kept = ((sample["draw"] * 1e9).astype("int64") % 5 == 0).to_numpy()
    idx, n = list(sample["idx"]), [np.asarray(x, "float32") / np.sum(x) for x in sample["n"]]
    train_rows = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(sample))
    rounds = -(-len(train_rows) // batch)
    epochs = max(2, -(-least_steps // rounds))
    steps, step = epochs * rounds, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train_rows), -(-len(train_rows) // batch)):
            places, weight = np.concatenate([idx[r] for r in rows]), np.concatenate([n[r] for r in rows])
            sizes = np.array([len(idx[r]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(weight[:, None] * table[places], starts)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            now = rate * (1 - step / steps)
            step += 1
            back = p @ layer.T
            layer -= 0.1 * now * hidden.T @ p
            bias -= 0.02 * now * p.sum(axis=0)
            np.add.at(table, places, -now * weight[:, None] * np.repeat(back, sizes, axis=0))
    model = Model(languages, (table @ layer).astype("float32"), bias.astype("float64"))
    check = np.flatnonzero(kept) if kept.any() else train_rows
    logits = np.stack([n[r] @ model.scores[idx[r]] for r in check]) + bias
    right = target[check]

    def loss(t):
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(check)), right], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.2, 5, 40), key=loss)
    top = model.probabilities(logits).max(axis=1)
    model.threshold = float(min(0.5, np.quantile(top, LOST)))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document by the checksum of its id; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the labelled documents that are not held out. Without any, it knows no language."""
    return train(*examples(documents.where(~held_out()), per_language))


def chunks(texts, size: int = CHUNK) -> Iterator[slice]:
    """Slices of a batch with about `size` characters each (one text at least)."""
    start, total = 0, 0
    for at, text in enumerate(texts):
        total += len(text or "") + 64
        if total >= size:
            yield slice(start, at + 1)
            start, total = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def identify(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score. A null text, or one without letters, is UNKNOWN
    with score 0; so is every text if the model has learned nothing."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))   # arrays only: executors need not have this module
    out_names = [*keep, "lang_pred", "score"]
    body, extra = (f"k{keep.index('text')}", []) if "text" in keep else ("body", ["body"])
    inputs = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col("text").alias(c) for c in extra])
    schema = T.StructType([*(T.StructField(f"k{i}", documents.schema[c].dataType) for i, c in enumerate(keep)),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
            for part in chunks(texts):
                names, top = model.predict(texts[part])
                kept = batch.slice(part.start, part.stop - part.start).columns[:len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(top, pa.float64())], names=schema.names)

    return inputs.mapInArrow(run, schema).toDF(*out_names)


def identify_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, from a model fitted on the others."""
    model = fit(documents)
    return identify(documents.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
