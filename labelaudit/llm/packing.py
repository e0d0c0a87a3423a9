"""Packing documents into training sequences with a grouping genetic algorithm on islands.

Documents become token counts (Spark tasks tokenize; only counts and checksums stay). Pieces of a
full sequence stand alone. The rest is dealt into blocks of a few thousand pieces; for each block
several islands evolve packings. A gene is a whole bin: crossover injects well-filled bins of one
parent into the other, drops the bins that hold a piece twice, and puts the displaced pieces where
they fit best. Between epochs each island sends its best packings to the next. A block's champion is
at most one sequence above what one packing of everything could save per block, some 0.05 %."""
from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stored

SEQUENCE = 2048
BLOCK = 4096                 # pieces evolved together
ISLANDS, EPOCHS, ROUNDS, POPULATION, ELITE = 3, 3, 6, 4, 2
END = 0                      # id that ends a document
SPECIAL = "<|endoftext|>"    # fixed value: the vocabulary's one special token
# Letters every Unicode version classes alike; other texts go the slower way.
RARE = re.compile("[^\x00-ɏ]")


def make_encoder(vocabulary: str, ranks: str | None = None):
    """text -> uint32 ids, as the `tokenizers` file `vocabulary` gives them. With `ranks`, the same
    vocabulary as byte-pair ranks, ordinary texts take a faster library with equal ids."""
    slow = []

    def exact(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer
            slow.append(Tokenizer.from_file(vocabulary))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    if ranks is None:
        return exact
    import base64

    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or RARE.search(text):
            return exact(text)
        return np.array(array("I", fast.encode_ordinary(text)), "<u4")
    return encode


def pieces(documents: DataFrame, vocabulary: str, ranks: str | None = None, limit: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lot), stored. A document is its ids and END; a longer
    one than `limit` is cut into pieces of `limit`, of which the first takes the remainder."""
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in (
        ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(vocabulary, ranks)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                edges = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    found.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*found)) or [()] * 4
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())),
                                              *(pa.array(c, t) for c, t in zip(columns, kinds))], names=schema.names)

    cut_up = documents.select("doc_id", "text").mapInArrow(cut, schema)
    return stored(cut_up.withColumn("lot", F.monotonically_increasing_id()), "pieces")


# --- one packing: a list of bins, each a tuple of piece numbers; pieces are numbered largest first ---

def best_fit(bins: list, loose: list, lengths: list, limit: int) -> list:
    """`bins` plus the `loose` pieces in the given order, each in the fullest bin that takes it."""
    room = sorted((limit - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    out = [list(b) for b in bins]
    for i in loose:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            gap, k = room.pop(at)
            out[k].append(i)
        else:
            gap, k = limit, len(out)
            out.append([i])
        if gap > lengths[i]:
            insort(room, (gap - lengths[i], k))
    return out


def fitness(bins: list, lengths: list, limit: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square fill); smaller is better."""
    fills = [sum(lengths[i] for i in b) / limit for b in bins]
    return len(bins), -sum(f * f for f in fills) / max(1, len(fills))


def crossover(mother: list, father: list, lengths: list, limit: int, rng: random.Random) -> list:
    """The mother's packing with well-filled bins of the father injected whole."""
    ranked = sorted(father, key=lambda b: -sum(lengths[i] for i in b))
    pool = ranked[:max(1, len(ranked) // 2)]
    gift = rng.sample(pool, max(1, min(len(pool), len(father) // 16)))
    given = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in mother:
        if given.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in given]
    poor = sorted(range(len(kept)), key=lambda k: sum(lengths[i] for i in kept[k]))[:max(1, len(kept) // 32)]
    for k in poor:                    # emptiest bins are broken up too, so they can vanish
        displaced += kept[k]
    gone = set(poor)
    kept = [b for k, b in enumerate(kept) if k not in gone]
    displaced.sort(key=lambda i: (-lengths[i], rng.random()))
    return best_fit(kept + gift, displaced, lengths, limit)


def evolve(lengths: list, elders: list, limit: int, rng: random.Random, rounds: int = ROUNDS,
           population: int = POPULATION) -> list:
    """The best packings, best first, after some rounds from `elders` (or from scratch)."""
    n, fewest = len(lengths), max(1, -(-sum(lengths) // limit))
    people = list(elders)
    if not people:
        people.append(best_fit([], list(range(n)), lengths, limit))
    while len(people) < population and min(map(len, people)) > fewest:
        order = sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
        people.append(best_fit([], order, lengths, limit))
    people.sort(key=lambda p: fitness(p, lengths, limit))
    for _ in range(rounds):
        if len(people[0]) <= fewest:
            break                     # no packing has fewer
        a, b = sorted(rng.sample(range(len(people)), 2))
        for mother, father in ((a, b), (b, a)):
            people.append(crossover(people[mother], people[father], lengths, limit, rng))
        people = sorted(people, key=lambda p: fitness(p, lengths, limit))[:population]
    return people[:ELITE]


def _bin_of(bins: list, n: int) -> list:
    out = np.zeros(n, "int32")
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _places(bins: list, lengths: list) -> np.ndarray:
    """Where each piece begins in its bin."""
    out = np.zeros(len(lengths), "int64")
    for b in bins:
        out[b] = np.cumsum([0, *(lengths[i] for i in b[:-1])])
    return out


def _bins(bin_of) -> list:
    out: dict[int, list] = {}
    for i, k in enumerate(bin_of):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


STATE = "block long, island int, lengths array<int>, elite array<array<int>>, at array<long>, bins int, fill double"


def _epoch(state: DataFrame, epoch: int, limit: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths = [int(x) for x in row.lengths]
                elders = [_bins(e) for e in (row.elite if row.elite is not None else [])]
                rng = random.Random(f"{seed}/{epoch}/{row.block}/{row.island}")
                best = evolve(lengths, elders, limit, rng)
                bins, fill = fitness(best[0], lengths, limit)
                yield pd.DataFrame([(row.block, row.island, lengths, [_bin_of(p, len(lengths)) for p in best],
                                     _places(best[0], lengths), bins, fill)],
                                   columns=["block", "island", "lengths", "elite", "at", "bins", "fill"])
    return state.select("block", "island", "lengths", "elite").mapInPandas(run, STATE)


def champions(blocks: DataFrame, limit: int = SEQUENCE, islands: int = ISLANDS, epochs: int = EPOCHS,
              seed: int = 7) -> DataFrame:
    """(block, bin_of array<int>, at array<long>) for (block, lengths array<int>, largest first): the
    bin of each piece and its place there."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = (blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths",
                           F.lit(None).cast("array<array<int>>").alias("elite"))
             .repartition(tasks, "block", "island"))
    state = _epoch(state, 0, limit, seed)
    for epoch in range(1, epochs):
        # each island's best stay, and go on to the next island
        sent = state.select("block", "lengths", "elite", F.explode(F.array(
            F.col("island"), (F.col("island") + 1) % islands)).alias("island"))
        met = sent.groupBy("block", "island").agg(
            F.first("lengths").alias("lengths"), F.flatten(F.collect_list("elite")).alias("elite"))
        state = _epoch(met, epoch, limit, seed)
    best = F.min_by(F.struct(F.col("elite")[0].alias("bin_of"), "at"), F.struct("bins", "fill", "island"))
    return state.groupBy("block").agg(best.alias("best")).select("block", "best.*")


def pack(documents: DataFrame, vocabulary: str, ranks: str | None = None, limit: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document
    in one sequence of at most `limit` tokens.

    Null text is an empty document (one END token). Repeated rows are documents of their own; null
    ids stay null. Which pieces meet in a block depends on their place in the input alone."""
    cut = pieces(documents, vocabulary, ranks, limit)
    small = cut.where(F.col("length") < limit)
    blocks = max(1, -(-small.count() // BLOCK))
    piece = F.struct((-F.col("length")).alias("less"), "lot", "doc_id", "piece", "start", "length", "ids_crc32")
    dealt = small.groupBy(F.pmod("lot", F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"))       # BLOCK pieces or so
    best = champions(dealt.select("block", F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths")), limit)

    rows = (dealt.join(best, "block").select("block", F.explode(F.arrays_zip("pieces", "bin_of", "at")).alias("x"))
            .select("x.pieces.*", (F.col("block") * (1 << 20) + F.col("x.bin_of")).alias("sequence_id"),
                    F.col("x.at").alias("offset")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = cut.where(F.col("length") == limit).withColumns({"sequence_id": -1 - F.col("lot"), "offset": F.lit(0).cast("long")})
    return rows.select(*columns).unionByName(whole.select(*columns))
