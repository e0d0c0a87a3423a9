"""Collocations: phrases of words that come together more often than apart, mined by Toivonen's method.

A sample proposes phrases. The full pass counts exactly what the sample proposed and
its negative border: every phrase that was not proposed but whose parts (less the last, less the first
word) were. If a phrase of the border turns out frequent, a further pass counts the phrases that have it
as a part, and so on until no frequent phrase is new: then every frequent phrase has been counted.
A low count in the sample would spare passes, but the pairs and triples of what it proposes are mostly
rare, and each costs a row; so only phrases that are surely frequent are proposed.

What was proposed is kept as a bit for a hash of the phrase, `BITS` for each length, whatever the corpus.
Two phrases that share a bit only make a pass count more than it has to; counts are by the phrase itself."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from ..sizes import small_table
from .texts import LOWER, chunks, mix, raw

BITS = 1 << 26               # of a filter: 8 MB
SAMPLE = 4                   # one document in so many is the sample
PROPOSED = 5                 # count in the sample from which a phrase is proposed
CHUNK = 1 << 21              # bytes of text counted together (one text at least)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
SALTS = 64
COUNTED = "lang string, size int, phrase string, n long"

IS_BREAK = np.zeros(256, bool)
IS_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
IS_SEPARATOR = IS_BREAK.copy()
IS_SEPARATOR[[0x20, 0x09]] = True


def _word_hash(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), "uint64", len(words))


def _join_hash(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of the phrase less its last and less its first word."""
    return mix(head * STEP + tail)


class Filter:
    """The phrases proposed so far, by length."""

    def __init__(self, bits: dict[int, np.ndarray]):
        self.bits = bits

    def has(self, size: int, hashes: np.ndarray) -> np.ndarray:
        place = hashes % np.uint64(BITS)
        return (self.bits[size][(place >> np.uint64(6)).astype("int64")] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def __or__(self, other: Filter) -> Filter:
        return Filter({k: self.bits[k] | other.bits[k] for k in self.bits})

    def __eq__(self, other) -> bool:
        return all(np.array_equal(self.bits[k], other.bits[k]) for k in self.bits)


class Words:
    """The words of some texts: `code` numbers the distinct (language, word) pairs, `piece` the pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, names: list[str]):
        part, bounds = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        n = len(part)
        apart = IS_SEPARATOR[part]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True                       # a text's end ends a word
        begins, ends = ~apart, ~apart
        begins[1:] &= apart[:-1] | edge[1:n]
        ends[:-1] &= apart[1:] | edge[1:n]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        breaks = np.append(np.int32(0), np.cumsum(IS_BREAK[part], dtype="int32"))
        owner = np.searchsorted(bounds, starts, "right") - 1
        self.piece = breaks[starts] + owner
        # words with one blank after each
        keep = ~apart
        keep[1:] |= apart[1:] & ~apart[:-1]
        place = np.append(np.int32(0), np.cumsum(keep, dtype="int32"))
        self.text = np.where(apart, np.uint8(0x20), LOWER[part])[keep]
        self.first, self.last = place[starts], place[stops]
        words = self.strings(np.arange(len(starts)), 1).dictionary_encode()
        word = words.indices.to_numpy().astype("int64")
        names_of, lang = words.dictionary.to_pylist(), langs[owner]
        self.code, pairs = pd.factorize(word * len(names) + lang)
        self.lang = pairs % len(names)
        self.hash = np.empty(len(pairs), "uint64")
        for k in np.unique(self.lang).tolist():
            own = np.flatnonzero(self.lang == k)
            self.hash[own] = _word_hash(names[k], [names_of[x] for x in (pairs[own] // len(names)).tolist()])
        self.langs = lang

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of `size` words from the words `at`."""
        begin, length = self.first[at], self.last[at + size - 1] - self.first[at]
        offsets = np.append(0, np.cumsum(length))
        inner = np.repeat(begin - offsets[:-1].astype("int32"), length)
        inner += np.arange(len(inner), dtype="int32")
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype("int64")), pa.py_buffer(self.text[inner]))


def _first_places(codes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    out = np.empty(n, "int64")
    out[codes[::-1]] = at[::-1]
    return out


def _counted(words: Words, names: list[str], most: int, old: Filter | None, new: Filter | None) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases up to `most` words whose parts `new` has (None: all), but for those whose
    parts `old` had; single words, and the total per language as size 0, only where `old` is None."""
    def give(size, at, counts):
        return pa.record_batch({"lang": pa.array(names).take(pa.array(words.langs[at])), "size": pa.array(np.full(len(at), size, "int32")),
                                "phrase": words.strings(at, size).cast(pa.string()), "n": counts.astype("int64")})

    n, code, hashes = len(words.code), words.code, words.hash
    if n == 0:
        return
    if old is None:
        counts = np.bincount(code)
        yield give(1, _first_places(code, len(counts), np.arange(n)), counts)
        totals = np.bincount(words.langs, minlength=len(names))
        yield pa.record_batch({"lang": names, "size": pa.array(np.zeros(len(names), "int32")), "phrase": [""] * len(names), "n": totals})
    alive = np.ones(len(hashes), bool) if new is None else new.has(1, hashes)
    known = np.zeros(len(hashes), bool) if old is None else old.has(1, hashes)
    for size in range(2, most + 1):
        at = np.arange(n - size + 1)
        at = at[words.piece[at] == words.piece[at + size - 1]]
        head, tail = code[at], code[at + 1]
        at = at[(head >= 0) & (tail >= 0) & alive[head] & alive[tail]]
        if len(at) == 0:
            return
        head, tail = code[at], code[at + 1]
        found, keys = pd.factorize(head * len(hashes) + tail)
        head, tail = keys // len(hashes), keys % len(hashes)
        before = known[head] & known[tail]
        fresh = np.flatnonzero(~before)
        if len(fresh):
            yield give(size, _first_places(found, len(keys), at)[fresh], np.bincount(found, minlength=len(keys))[fresh])
        code = np.full(n, -1, "int64")
        code[at] = found
        hashes = _join_hash(hashes[head], hashes[tail])
        if size < most:
            alive = np.ones(len(hashes), bool) if new is None else new.has(size, hashes)
            known = before & (old.has(size, hashes) if old is not None else False)


def count_phrases(documents: DataFrame, most: int, old: Filter | None = None, new: Filter | None = None) -> DataFrame:
    """(lang, size, phrase, n) over documents (lang, text), see `_counted`."""
    context = documents.sparkSession.sparkContext
    held = context.broadcast((old, new))

    def work(batches):
        before, now = held.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lang = batch.column(0).dictionary_encode()
            names, langs = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype("int64")
            data, offsets = raw(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                yield from _counted(Words(data, offsets[a:b + 1], langs[a:b], names), names, most, before, now)

    parts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(work, COUNTED)
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def proposed(phrases: DataFrame, most: int) -> Filter:
    """The filter of the `phrases` (lang, size, phrase) of fewer than `most` words."""
    def work(batches):
        for batch in batches:
            for size in range(1, most):
                own = batch.filter(pa.compute.equal(batch.column("size"), size))
                if own.num_rows == 0:
                    continue
                langs, words = own.column("lang").dictionary_encode(), [p.split(" ") for p in own.column("phrase").to_pylist()]
                level = [np.empty(len(words), "uint64") for _ in range(size)]
                which = langs.indices.to_numpy()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    rows = np.flatnonzero(which == k)
                    for j in range(size):
                        level[j][rows] = _word_hash(lang, [words[r][j] for r in rows.tolist()])
                while len(level) > 1:
                    level = [_join_hash(a, b) for a, b in zip(level, level[1:])]
                place = level[0] % np.uint64(BITS)
                yield pa.record_batch({"size": np.full(len(place), size, "int32"), "slot": (place >> np.uint64(6)).astype("int32"),
                                       "mask": (np.uint64(1) << (place & np.uint64(63))).view("int64")})

    # BITS / 64 rows a length at most
    rows = (phrases.where((F.col("size") > 0) & (F.col("size") < most)).select("lang", "size", "phrase")
            .mapInArrow(work, "size int, slot int, mask long").groupBy("size", "slot").agg(F.bit_or("mask").alias("mask")).toPandas())
    bits = {}
    for size in range(1, most):
        own = rows[rows["size"] == size]
        bits[size] = np.zeros(BITS // 64, "uint64")
        bits[size][own["slot"].to_numpy()] = own["mask"].to_numpy().astype("int64").view("uint64")
    return Filter(bits)


def frequent_phrases(documents: DataFrame, most: int, least: int, sample: int = SAMPLE, proposing: int = PROPOSED) -> tuple[DataFrame, int]:
    """((lang, size, phrase, n) of all phrases of 1 to `most` words with n >= `least`, and as size 0 the
    number of words; number of full passes). `sample` and `proposing` change the passes, not the result."""
    rows = documents.select("lang", "text")
    part = rows.where(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(sample)) == 0)
    old, new, found, passes = None, proposed(count_phrases(part, most - 1).where(F.col("n") >= proposing), most), None, 0
    while True:
        counts = count_phrases(rows, most, old, new).where((F.col("n") >= least) | (F.col("size") == 0))
        fresh = stored(counts, "phrases")
        found = fresh if found is None else found.unionByName(fresh)
        passes += 1
        grown = new | proposed(fresh, most)
        if grown == new:
            return found, passes
        old, new = new, grown


def collocations(documents: DataFrame, most: int = 3, least: int = 10, cover: int = 50, top: int = 2000,
                 sample: int = SAMPLE, proposing: int = PROPOSED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    documents: (lang, text); other columns are not read. Null languages are 'und', null texts empty.
    A phrase of 2 to `most` words within a piece counts from a = `least` occurrences. Cut after its first
    words into parts of l and r occurrences it scores floor(1000000 * a * a / (l * r)); the least cut
    counts, of equal ones the earliest. Phrases inside a longer one that has `cover` % of their
    occurrences are left out. Order: score, a, both falling, then phrase by bytes. Repeated rows are
    documents of their own; a language without such phrases has no row. a, l, r up to 10**15."""
    found, _ = frequent_phrases(documents, most, least, sample, proposing)
    totals = small_table(found.where("size = 0").select("lang", F.col("n")))
    counts = found.where("size > 0").select("lang", "phrase", "size", F.col("n").alias("a"))
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    piece = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    sides = [counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"]).withColumns(
        {"over": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    within = (phrases.where("size > 2")
              .select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("short"))
              .select("lang", "a", "words", "short", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("short") + 1)).alias("from"))
              .groupBy("lang", piece(F.col("from"), F.col("short")).alias("phrase")).agg(F.max("a").alias("longer")))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * cover, F.lit(True)))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    # the first of each salt, then the first of those: no task has all phrases of a language
    some = rows.withColumn("rank", rank("lang", "salt")).where(F.col("rank") <= top)
    first = some.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same for DuckDB: all phrases counted.
SQL = r"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS size))
  GROUP BY 1, 2, 3),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, n AS a FROM g WHERE size > 1 AND n >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.n AS l, r.n AS r,
         (1000000::HUGEINT * k.a * k.a // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY 1, 2),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000"""
