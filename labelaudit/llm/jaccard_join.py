"""Set similarity self-join on word shingles, exact, by the pigeonhole on parts of the universe.

Sets of similarity 0.8 or more differ in at most H = size / 4 shingles (size of the smaller one).
Shingles are hashed into segments, by size band. If the segments of two sets are allowed to differ in
d(i) shingles each, with the sum of d(i) + 1 above H, some segment differs by no more than it is
allowed: 0 for an exact segment, 1 for one whose one-deletion neighbourhood is indexed too, and
nothing at all for one left out. A set of size s uses the first s/4 + 1 segments of its band's
partition, the first `deep(H)` of them with neighbourhoods; that is `deep(H)` more than the pigeonhole
needs, and each set spends these where its signatures cost most: on empty segments, on neighbourhoods
of single shingles, and then on the signatures that most other sets share. It still has rows for
them, which others may find, but looks nobody up by them.

Sets that share a signature are candidates. Those of a signature are first compared with one of them
only, its leader, the set that shares most; what that joins into a component needs no further look.
Candidates of different components come next: in a small group each with each, in a large one by what
they differ in from one leader of all groups that overlap. Of two sets that are not both similar to the leader the differences
have some shingle in common, and a prefix filter on the differences finds it without a look at all
pairs. Sets that have little in common with their leader are joined by their own rarest shingles
instead, each set once. Equal sets are one set throughout.

Shingles are moved only for pairs that may be similar: every set has a parity sketch, one bit per
bucket for an odd number of its shingles there. Sets differ in at least as many shingles as their
sketches in bits, so a pair whose sketches are too far apart is settled, and nothing is lost."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import stored
from .components import components
from .texts import BASE, Powers, chunks, mix, raw, shingle_hashes, word_hashes

PERCENT = 80
HOT = 1                      # sets of a signature above which it may be left out
LARGE = 8                    # sets of a signature above which differences are joined
COUNTS = 1 << 18             # cells of the table of shingle counts
BLOOM = 1 << 24              # bits of the filter for sets to be compared
SKETCH = 64                  # longs of a parity sketch
NEAR, FAR = 1.0, 0.6         # sketch distance over size: the join by differences takes up to NEAR, the other from FAR
HOT_SHARE = 1024             # a shingle cell with over 1 / HOT_SHARE of all shingles is hot
EXACT, PROBE, DEEP, LEFT = 1, 2, 4, 8      # flags of a row; above them how much its set may leave out

BANDS = [4]                  # sets below 4 shingles are equal or not similar
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 3 // 2))
BANDS = np.array(BANDS, "int64")
SEGMENTS = (BANDS[1:] - 1) // 4 + 1


def deep(h: np.ndarray) -> np.ndarray:
    return np.minimum(h + 1, 10 + h // 7)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, table: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, sizes, set ids): the distinct shingles of each text, one text after the other. Equal
    sets have equal ids; the id of the empty set is 0."""
    words, first = word_hashes(data, offsets, table)
    hashes, owner, _ = shingle_hashes(words, first)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    n = len(offsets) - 1
    sizes = np.bincount(owner, minlength=n)
    ids = np.zeros(n, "uint64")
    np.add.at(ids, owner, mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    ids = np.where(sizes > 0, mix(ids + sizes.astype("uint64")), np.uint64(0))
    return hashes, sizes, ids.view("int64")


def signatures(hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set id, flag) rows of sets given one after the other. The flag holds EXACT, PROBE and
    DEEP and, times LEFT, how many more signatures the set may leave out."""
    starts = np.cumsum(sizes) - sizes
    band = np.searchsorted(BANDS, sizes, "right") - 1
    own = np.flatnonzero(band >= 0)
    # as the larger of a pair, a set is also found by smaller ones of the band below
    below = np.flatnonzero((band >= 1) & (4 * sizes <= 5 * (BANDS[np.maximum(band, 0)] - 1)))
    sets = np.concatenate([own, below])
    scheme = np.concatenate([band[own], band[below] - 1])
    probing = np.arange(len(sets)) < len(own)
    if not len(sets):
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int16")
    h = np.minimum(sizes[sets] // 4, SEGMENTS[scheme] - 1)
    used, dug = h + 1, deep(h)
    base = np.cumsum(used) - used
    # the shingles of each participation, with their segments
    n = sizes[sets]
    who = np.repeat(np.arange(len(sets)), n)
    values = hashes[np.repeat(starts[sets], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    salt = mix(scheme.astype("uint64") + np.uint64(0x1234567))
    segment = (mix(values ^ salt[who]) % SEGMENTS[scheme][who].astype("uint64")).astype("int64")
    kept = segment < used[who]
    who, segment, values = who[kept], segment[kept], mix(values[kept])
    cell = base[who] + segment
    total = int(used.sum())
    sums = np.zeros(total, "uint64")
    np.add.at(sums, cell, values)
    counts = np.bincount(cell, minlength=total)
    owner = np.repeat(np.arange(len(sets)), used)
    place = np.arange(total) - base[owner]
    cell_salt = mix(salt[owner] + place.astype("uint64") * np.uint64(0xC2B2AE3D27D4EB4F))
    is_deep = place < dug[owner]
    # what is left out first: empty segments, and neighbourhoods of single shingles
    spent = np.bincount(owner, (counts == 0) * (1 + is_deep) + ((counts == 1) & is_deep), len(sets)).astype("int64")
    left = dug - spent
    short = left < 0                  # cannot afford that: such a set leaves out nothing
    left = np.clip(left, 0, 1000)
    looks = probing[owner] & ((counts > 0) | short[owner])
    exact = mix(sums ^ cell_salt), owner, EXACT + PROBE * looks + DEEP * is_deep
    digs = is_deep[cell]
    gone = mix((sums[cell] - values) ^ cell_salt[cell])[digs]
    by = who[digs]
    looks = probing[by] & ((counts[cell[digs]] > 1) | short[by])
    # a set without a neighbour's last shingle: the neighbourhood of an empty segment is itself
    signature, by, flag = (np.concatenate(x) for x in zip(exact, (gone, by, PROBE * looks)))
    return signature.view("int64"), ids[sets[by]], (flag + LEFT * left[by]).astype("int16")


def _each_batch(documents: DataFrame, schema: T.StructType, make) -> DataFrame:
    """`make(shingles, sizes, ids, first row)` for chunks of texts, its columns as rows of `schema`;
    texts are the last column, others are passed to `make` through the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, state = Powers(BASE), set()
        for batch in batches:
            data, offsets = raw(batch.column(batch.num_columns - 1))
            for a, b in chunks(offsets):
                columns = make(*shingle_sets(data, offsets[a:b + 1], table), batch.slice(a, b - a), state)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
    return documents.mapInArrow(run, schema)


def _new(ids: np.ndarray, sizes: np.ndarray, seen: set, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rows of sets that this task has not met yet."""
    out = []
    for k, x in enumerate(ids.tolist()):
        if sizes[k] and x not in seen and (wanted is None or wanted[k]):
            seen.add(x)
            out.append(k)
    return np.array(out, "int64")


def _pick(hashes, sizes, rows):
    starts = np.cumsum(sizes) - sizes
    n = sizes[rows]
    return hashes[np.repeat(starts[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], n


def parity_sketches(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, SKETCH) uint64: the sketches of sets given one after the other."""
    out = np.zeros(len(n) * SKETCH, "uint64")
    bucket = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    cell = np.repeat(np.arange(len(n)), n) * SKETCH + ((bucket >> np.uint64(6)) % np.uint64(SKETCH)).astype("int64")
    np.bitwise_xor.at(out, cell, np.uint64(1) << (bucket & np.uint64(63)))
    return out.reshape(-1, SKETCH)


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


def set_table(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every document row, stored."""
    schema = _fields(("doc_id", documents.schema["doc_id"].dataType), ("n_shingles", T.LongType()), ("set_id", T.LongType()))

    def make(hashes, sizes, ids, batch, seen):
        return [batch.column(0), pa.array(sizes.astype("int64")), pa.array(ids)]
    return stored(_each_batch(documents.select("doc_id", "text"), schema, make), "sets")


def signature_groups(documents: DataFrame) -> DataFrame:
    """(signature, set_id, flag, n), stored: rows of signatures that two sets or more have and by which
    some set looks others up."""
    schema = _fields(("signature", T.LongType()), ("set_id", T.LongType()), ("flag", T.ShortType()))

    def make(hashes, sizes, ids, batch, seen):
        rows = _new(ids, sizes, seen)
        picked, n = _pick(hashes, sizes, rows)
        return [pa.array(x) for x in signatures(picked, n, ids[rows])]

    rows = _each_batch(documents.select("text"), schema, make)
    same = Window.partitionBy("signature")
    grouped = rows.withColumns({
        "n": F.count("*").over(same), "first": F.min("set_id").over(same), "last": F.max("set_id").over(same),
        "exact": F.max(F.col("flag").bitwiseAND(EXACT)).over(same), "looks": F.max(F.col("flag").bitwiseAND(PROBE)).over(same)})
    met = grouped.where("n > 1 AND first <> last AND exact > 0 AND looks > 0")
    return stored(met.select("signature", "set_id", "flag", "n").distinct(), "signatures")


def spend(groups: DataFrame) -> DataFrame:
    """(signature, set_id, exact, looks, n, leader): `groups` after each set has left out the dearest of
    the signatures it looks others up by, as many as it may; groups by which nobody looks any more are
    gone. The leader looks itself and shares most with others, over all its signatures."""
    looks = F.col("flag").bitwiseAND(PROBE) > 0
    allowed = F.floor(F.col("flag") / LEFT)
    # a segment with a neighbourhood counts twice: without its own signature the latter is worth nothing
    cost = F.when(F.col("flag").bitwiseAND(EXACT + DEEP) == EXACT + DEEP, 2).otherwise(1)
    dear = groups.where(looks & (F.col("n") > HOT) & (allowed > 0))
    order = Window.partitionBy("set_id").orderBy(F.col("n").desc(), "signature", "flag").rowsBetween(Window.unboundedPreceding, 0)
    skipped = (dear.withColumn("spent", F.sum(cost).over(order)).where(F.col("spent") <= allowed)
               .select("signature", "set_id", "flag", F.lit(True).alias("skipped")))
    kept = groups.join(skipped, ["signature", "set_id", "flag"], "left").groupBy("signature", "set_id").agg(
        F.max(F.col("flag").bitwiseAND(EXACT) > 0).alias("exact"), F.max(looks & F.col("skipped").isNull()).alias("looks"))
    same = Window.partitionBy("signature")
    looked = stored(kept.withColumns({"n": F.count("*").over(same), "any": F.max("looks").over(same)})
                    .where(F.col("any") & (F.col("n") > 1)).drop("any"), "looked")
    weight = looked.groupBy("set_id").agg(F.sum("n").alias("weight"))
    best = F.max(F.when(F.col("looks"), F.struct("weight", "set_id"))).over(same)
    return looked.join(weight, "set_id").withColumn("leader", best["set_id"]).drop("weight")


def _bit() -> Column:
    return F.pmod("set_id", F.lit(BLOOM)) + 1          # Spark's buckets hold bits 1 to 32768 and so on


def id_bits(ids: DataFrame) -> DataFrame:
    """(bucket, bits) of the ids (set_id): BLOOM bits at most, whatever the data."""
    return (ids.select(F.bitmap_bucket_number(_bit()).alias("bucket"), F.bitmap_bit_position(_bit()).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def element_table(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, size, sketch, elements): the shingles of the sets in `wanted` (set_id) and of some others,
    stored by the tasks that read the texts. A filter of fixed size keeps most others out. A set that several
    tasks met has equal rows."""
    bits = np.zeros((BLOOM // 32768, 4096), "uint8")
    for r in id_bits(wanted).collect():
        bits[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), "uint8")
    shared = documents.sparkSession.sparkContext.broadcast(bits.ravel())
    schema = _fields(("set_id", T.LongType()), ("size", T.IntegerType()), ("sketch", T.ArrayType(T.LongType())),
                     ("elements", T.ArrayType(T.LongType())))
    def make(hashes, sizes, ids, batch, seen):
        bits, x = shared.value, ids % BLOOM
        rows = _new(ids, sizes, seen, (bits[x >> 3] >> (x & 7).astype("uint8")) & 1)
        picked, n = _pick(hashes, sizes, rows)
        sketches = parity_sketches(picked, n).ravel().view("int64")
        return [pa.array(ids[rows]), pa.array(n.astype("int32")),
                pa.ListArray.from_arrays(np.arange(0, len(sketches) + 1, SKETCH, dtype="int32"), sketches),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype("int32"), picked.view("int64"))]

    return stored(_each_batch(documents.select("text"), schema, make), "elements")


def once(elements: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per set of `elements`. With `ids` (set_id) most other sets go before any row is moved."""
    if ids is not None:
        byte = F.conv(F.hex(F.expr("substring(bits, int(place div 8) + 1, 1)")), 16, 10).cast("int")
        elements = (elements.withColumns({"bucket": F.bitmap_bucket_number(_bit()), "place": F.bitmap_bit_position(_bit())})
                    .join(F.broadcast(id_bits(ids)), "bucket")
                    .where(byte.bitwiseAND(F.expr("shiftleft(1, int(place % 8))")) > 0).select(*elements.columns))
    return elements.dropDuplicates(["set_id"])


def _with_elements(pairs: DataFrame, elements: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs`, a stored table, with the shingles x of the set in column `a` and y of that in `b`."""
    sets = elements.select("set_id", "elements")
    left = once(sets, pairs.select(F.col(a).alias("set_id"))).toDF(a, "x")
    right = once(sets, pairs.select(F.col(b).alias("set_id"))).toDF(b, "y")
    return pairs.join(left, a).join(right, b)


def folded(sketch: str) -> Column:
    """A sketch an eighth as long: buckets that fall together hold the parity of both, so sets still differ
    in at least as many shingles as these in bits."""
    return F.expr(f"transform(sequence(0, {SKETCH // 8 - 1}), i -> "
                  f"aggregate(slice({sketch}, i * 8 + 1, 8), 0L, (t, x) -> t ^ x))")


def sketched(pairs: DataFrame, elements: DataFrame, a: str, b: str, short: bool = False) -> DataFrame:
    """`pairs`, a stored table, with the sizes n and m of the sets in columns `a` and `b` and the distance of
    their sketches, or of their `short` ones."""
    sets = elements.select("set_id", "size", (folded("sketch") if short else F.col("sketch")).alias("sketch"))
    left = once(sets, pairs.select(F.col(a).alias("set_id"))).toDF(a, "n", "_x")
    right = once(sets, pairs.select(F.col(b).alias("set_id"))).toDF(b, "m", "_y")
    apart = F.aggregate(F.zip_with("_x", "_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return pairs.join(left, a).join(right, b).withColumn("apart", apart).drop("_x", "_y")


def may_be_similar(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), a stored table, that sizes and sketches leave open, stored; by short sketches
    first: similar sets differ in a ninth of their sizes' sum at most."""
    for short in (True, False):
        pairs = stored(sketched(pairs, elements, "a", "b", short)
                       .where("100 * least(n, m) >= 80 * greatest(n, m) AND 9 * apart <= n + m").select("a", "b"), "likely")
    return pairs


def verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by exact counts."""
    n, m, i = F.size("x"), F.size("y"), F.col("i")
    return (_with_elements(pairs, elements, "a", "b").where(100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
            .withColumn("i", F.size(F.array_intersect("x", "y")))
            .where(100 * i >= PERCENT * (n + m - i)).select("a", "b"))


def centred(near: DataFrame) -> DataFrame:
    """(leader, set_id, component), stored: each set of `near`, a stored table of the same columns, once. Sets
    that have leaders in common, directly or not, are one family, and the leader of most of them is the leader of all."""
    part = components(near.select(F.col("leader").alias("a"), F.col("set_id").alias("b"))).withColumnsRenamed(
        {"node": "set_id", "component": "family"})
    most = (near.groupBy("leader").agg(F.count("*").alias("n")).join(part.withColumnRenamed("set_id", "leader"), "leader")
            .groupBy("family").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader")))
    members = near.select("set_id", "component").distinct().join(part, "set_id")
    return stored(members.join(most, "family").select("leader", "set_id", "component"), "centred")


def differing_pairs(near: DataFrame, elements: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components among the sets (leader, set_id, component) of `near`, a
    stored table, that have a leader in common: all that are similar, and few others. The sets of `near` were
    compared with their leader.

    A set may have many leaders, so each is compared with one set of its family only, called the leader
    below (`centred`); it and that are a pair too, if they were not compared before.

    With d shingles of difference from the leader, similar sets a and b have at least
    t = (d(a) + d(b) - (size(a) + size(b)) / 9) / 2 of them in common. For a set that is not similar to
    the leader t is at least 0.9 of what d exceeds a ninth of its and the leader's size by; for one that
    is, with a partner that is not, above 4/9 of d. So the first d - t + 1 differences of both have one
    in common, in any order that both share: shingles the leader has not come first, rare ones before
    frequent ones (by counts in a table of fixed size, so that some shingles count together)."""
    counts = (elements.select(F.explode("elements").alias("shingle"))
              .groupBy(F.pmod("shingle", F.lit(COUNTS)).alias("cell")).count().toPandas())
    table = np.zeros(COUNTS, "int64")
    table[counts["cell"].to_numpy("int64")] = counts["count"]
    shared = elements.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for pdf in batches:
            rows = []
            for leader, set_id, component, x, y in pdf.itertuples(index=False, name=None):
                delta = np.setxor1d(x, y, assume_unique=True)
                order = np.lexsort((delta, often[delta % COUNTS], np.isin(delta, y)))
                d, over = len(delta), len(delta) - (len(x) + len(y)) / 9
                need = max(1, math.ceil(0.9 * over - 1e-6)) if over > 0 else 4 * d // 9 + 1
                rows.append(pd.DataFrame({"leader": leader, "set_id": set_id, "component": component, "size": len(x),
                                          "d": d, "at": np.arange(max(0, d - need + 1)), "shingle": delta[order][:max(0, d - need + 1)]}))
            yield pd.concat(rows)

    family = centred(near)
    deltas = (_with_elements(family, elements, "set_id", "leader").select("leader", "set_id", "component", "x", "y")
              .mapInPandas(run, "leader long, set_id long, component long, size int, d int, at int, shingle long"))
    deltas = stored(deltas, "differences")
    fresh = (family.where("set_id <> leader").join(near.select("leader", "set_id"), ["leader", "set_id"], "left_anti")
             .select(F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")))
    mixed = (deltas.groupBy("leader", "shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("leader", "shingle"))
    open_rows = deltas.join(mixed, ["leader", "shingle"], "left_semi")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    return fresh.unionByName(a.join(b, (F.col("a.leader") == F.col("b.leader")) & (F.col("a.shingle") == F.col("b.shingle")))
            .where("""a.set_id < b.set_id AND a.component <> b.component
                      AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
                      AND 2 * least(a.d - a.at, b.d - b.at) >= a.d + b.d - floor((a.size + b.size) / 9)""")
            .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")))


def rare_shingle_pairs(far: DataFrame, elements: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of different components among the sets (set_id, component): all that are
    similar, and few others. Two similar sets share one of their first size / 5 + 1 shingles, in any
    order that is the same for all: here rare ones first, by exact counts. A shingle that one set alone
    has is counted, not joined. Before the first that they share, similar sets of sizes n and m have so few
    that 4/9 of n + m can still follow in both; other pairs are not made. Hot shingles come last and are not brought together for counting."""
    sets = stored(once(elements.select("set_id", "size", "elements"), far.select("set_id")).join(far, "set_id"), "far")
    total = sets.agg(F.sum("size")).first()[0] or 0
    rows = sets.select("set_id", F.explode("elements").alias("shingle"))
    cell = F.pmod("shingle", F.lit(COUNTS))
    hot = [r["cell"] for r in rows.groupBy(cell.alias("cell")).count()          # fewer than HOT_SHARE
           .where(F.col("count") > max(HOT_SHARE, total // HOT_SHARE)).collect()]
    same = Window.partitionBy("shingle")
    cold = rows.where(~cell.isin(hot)).withColumn("n", F.count("*").over(same)).where("n > 1")
    common = cold.unionByName(rows.where(cell.isin(hot)).withColumn("n", F.lit(1 << 62)))
    own = Window.partitionBy("set_id")               # a set's shingles: bounded by its text
    prefix = (common.withColumns({"at": F.row_number().over(own.orderBy("n", "shingle")), "shared": F.count("*").over(own)})
              .join(sets.select("set_id", "component", "size"), "set_id")
              .withColumn("place", F.expr("at + size - shared")).where("place <= size div 5 + 1")
              .select("set_id", "component", "size", "place", "shingle"))
    prefix = stored(prefix, "rare")
    mixed = (prefix.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("shingle"))
    open_rows = prefix.join(mixed, "shingle", "left_semi")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    return (a.join(b, F.col("a.shingle") == F.col("b.shingle"))
            .where("""a.set_id < b.set_id AND a.component <> b.component
                      AND 9 * (1 + least(a.size - a.place, b.size - b.place)) >= 4 * (a.size + b.size)""")
            .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")))


def similar_sets(documents: DataFrame) -> DataFrame:
    """(node, component) of the sets that are similar to some other set."""
    groups = stored(spend(signature_groups(documents)), "groups")
    stars = stored(groups.where("set_id <> leader").select(
        F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")).distinct(), "pairs")
    elements = element_table(documents, groups.select("set_id").distinct())
    likely = may_be_similar(stars, elements)
    first = stored(verified(likely, elements), "verified")
    part = components(first)
    labelled = groups.join(part.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    # a group with one set that looks has been seen whole: that set is its leader
    mixed = (labelled.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                               F.count(F.when(F.col("looks"), 1)).alias("lookers"))
             .where("low <> high AND lookers > 1").select("signature"))
    open_rows = stored(labelled.where("set_id <> leader").join(mixed, "signature"), "open")
    few = open_rows.where(F.col("n") <= LARGE)
    a, b = few.alias("a"), few.alias("b")
    rest = (a.join(b, F.col("a.signature") == F.col("b.signature"))
            .where("a.set_id < b.set_id AND a.component <> b.component AND (a.exact OR b.exact) AND (a.looks OR b.looks)")
            .select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")))
    # similar sets' distances to their leader differ by a ninth of their sizes' sum at most: if one is
    # beyond NEAR times its size, the other is beyond FAR times its own
    many = stored(open_rows.where(F.col("n") > LARGE).select("leader", "set_id", "component").distinct(), "many")
    family = stored(sketched(many, elements, "set_id", "leader"), "family")
    near = stored(family.where(F.col("apart") <= NEAR * F.col("n")).select("leader", "set_id", "component"), "near")
    far = family.where(F.col("apart") >= FAR * F.col("n")).select("set_id", "component").distinct()
    rest = rest.unionByName(rare_shingle_pairs(far, elements)).unionByName(differing_pairs(near, elements))
    likely = may_be_similar(stored(rest.distinct(), "pairs"), elements)
    second = verified(likely, elements)
    links = first.unionByName(second).unionByName(part.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = components(links)
    return found


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row: its set's size and the least doc_id of
    the documents it is linked with, directly or not.

    Null and empty texts, and texts without words, have no shingles and are alone. Repeated rows and
    equal texts are one set; an id that repeats with other texts is several. Among null ids the least
    is the least id that is not null, or null."""
    sets = set_table(documents)
    found = similar_sets(documents).withColumnRenamed("node", "set_id")
    least = sets.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    labelled = least.join(found, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    names = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    by_set = stored(labelled.join(names, "component").select("set_id", "component_id"), "components")
    return (sets.join(by_set, "set_id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
