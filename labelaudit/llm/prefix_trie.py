"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. The
path of its least member runs from every node down to that conversation's end, so (least member, depth)
names a node, and in the order of these names a path lies together and children of a node are in order.

Every node has an enter and an exit arc; the tour is the list of arcs in depth-first order. It is ranked
without walking it in one place: each task joins the arcs of its range of nodes into segments (pointer
jumping in arrays), the list of segments is halved and halved by taking out segments whose hash is less
than their neighbours', a rest of `REST` segments is ranked in one task, and offsets go back the same
way. Totals up to a node's enter and exit arcs give what its subtree holds."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.running import running
from ..session import stored

FAMILY = 20                  # conversations c - c % FAMILY ... share first turns when rebuilt
BLOCK = 200_000              # nodes a task of the ranking holds, about
REST = 1 << 16               # segments that one task ranks
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = ("steps", "leaves", "saved")
END = -1                     # what follows the tour's last arc


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 0, one, two, words): turns in order, by two hashes of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("one"),
        F.xxhash64(F.lit(11), text, role, F.length(text)).alias("two"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("lot"))      # only splits rows that are equal
    placed = running(turns, ["conv_id"], ["turn", "role", "one", "two", "lot"])
    return placed.select("conv_id", F.col("_at").alias("position"), "one", "two", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations (conv_id, size)) with the first h turns of every conversation c taken from
    conversation c - c % 20, h = crc32(decimal c) % 4; a conversation may be left without turns."""
    turns = stored(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    given = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shape = stored(sizes.select("conv_id", "n", base.alias("base"), h.alias("h")).join(given, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("b"), "n"), "shapes")
    first = turns.where((F.col("position") < 3) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    lent = shape.where("b > 0").select("conv_id", "base", "b").join(first, "base").where("position < b")
    own = turns.join(shape.select("conv_id", "h", "b"), "conv_id").where("position >= h")
    columns = ["conv_id", "position", "one", "two", "words"]
    rows = lent.select(columns).unionByName(own.withColumn("position", F.col("position") - F.col("h") + F.col("b")).select(columns))
    size = F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return rows, shape.select("conv_id", size.alias("size"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, words, u1, u2): keys of the first `depth` turns and of one turn less, as
    wrapping sums of hashes of (place, turn)."""
    salted = turns.select("conv_id", "position", "words", F.xxhash64("position", "one", "two").alias("k1"),
                          F.xxhash64("two", "position", "one").alias("k2"))
    summed = running(salted, ["conv_id"], ["position"], ["k1", "k2"])

    def before(batches):
        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            yield pa.record_batch({"conv_id": c["conv_id"], "depth": c["position"] + 1, "words": c["words"], "k1": c["k1_upto"],
                                   "k2": c["k2_upto"], "u1": c["k1_upto"] - c["k1"], "u2": c["k2_upto"] - c["k2"]})

    return summed.mapInArrow(before, "conv_id long, depth long, words long, k1 long, k2 long, u1 long, u2 long")


def _nodes(prefixes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(nid, conv_id, depth, n_convs, words, k1, k2, u1, u2), stored; nid is in order of (conv_id, depth)."""
    rows = prefixes.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.first("u1").alias("u1"), F.first("u2").alias("u2"))
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("words"), zero.alias("u1"), zero.alias("u2"))
    every = rows.unionByName(root)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = every.repartitionByRange(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    return stored(order.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def _jump(before: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its chain, weights up to and with it) of every item; `before` is the item before, or the
    item itself at the head of a chain."""
    head, total, at = before.copy(), weights.copy(), before
    moving = np.flatnonzero(head != head[head])
    inner = np.flatnonzero(before != np.arange(len(before)))
    start = weights.copy()
    # pointers jump over twice as many items each round; `start` is the sum over the items jumped over, without the head
    start[before == np.arange(len(before))] = 0
    while len(moving):
        start[moving] += start[head[moving]]
        head[moving] = head[head[moving]]
        moving = moving[head[moving] != head[head[moving]]]
    total[inner] = start[inner] + weights[head[inner]]
    return head, total


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the arcs of a range of nodes. Arc 2 * nid enters a node, 2 * nid + 1 leaves it. Of each arc:
    the segment (its first arc), the weights up to and with it, and what follows if it ends a segment."""
    batches = list(batches)
    n = sum(b.num_rows for b in batches)
    if n == 0:
        return
    table = pa.Table.from_batches(batches)
    nid, child, sibling, parent, leaf, saved = (table.column(c).to_numpy() for c in ("nid", "child", "sibling", "parent", "leaf", "saved"))
    after = np.empty(2 * n, "int64")
    after[0::2] = np.where(child >= 0, 2 * child, 2 * nid + 1)
    after[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, END))
    place = np.minimum(np.searchsorted(nid, after >> 1), n - 1)
    here = (after >= 0) & (nid[place] == after >> 1)
    target = 2 * place + (after & 1)
    before = np.arange(2 * n)
    before[target[here]] = np.flatnonzero(here)
    weights = np.zeros((2 * n, 3), "int64")
    weights[:, 0], weights[0::2, 1], weights[0::2, 2] = 1, leaf, saved
    head, total = _jump(before, weights)
    arc = np.empty(2 * n, "int64")
    arc[0::2], arc[1::2] = 2 * nid, 2 * nid + 1
    out = {"nid": pa.array(nid)}
    for side, name in enumerate(("enter", "leave")):
        out[f"{name}_segment"] = pa.array(arc[head[side::2]])
        out[f"{name}_next"] = pa.array(after[side::2], mask=here[side::2])
        for j, w in enumerate(WEIGHTS):
            out[f"{name}_{w}"] = pa.array(total[side::2, j])
    yield pa.record_batch(out)


SEGMENTS = "nid long, " + ", ".join(f"{name}_segment long, {name}_next long, " + ", ".join(f"{name}_{w} long" for w in WEIGHTS)
                                    for name in ("enter", "leave"))


def _rank_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights before each segment of a list that is all here."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches).sort_by("segment")
    segment, after = table.column("segment").to_numpy(), table.column("next").to_numpy()
    weights = np.stack([table.column(w).to_numpy() for w in WEIGHTS], axis=1)
    before, inner = np.arange(len(segment)), np.flatnonzero(after != END)
    before[np.searchsorted(segment, after[inner])] = inner
    _, total = _jump(before, weights)
    total -= weights
    yield pa.record_batch({"segment": segment} | {w: total[:, j] for j, w in enumerate(WEIGHTS)})


def list_rank(segments: DataFrame, rest: int = REST) -> DataFrame:
    """(segment, *WEIGHTS before it) for one list of segments (segment, next, *WEIGHTS); `next` is -1 at
    the end. About a third of the segments goes in each round, so all rounds move about as much as two."""
    schema = "segment long, " + ", ".join(f"{w} long" for w in WEIGHTS)
    rows, taken, turn = stored(segments, "list"), [], 0
    while rows.count() > rest:
        coin = lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c))
        ahead = rows.select(F.col("segment").alias("next"), F.col("next").alias("then"), *[F.col(w).alias(f"n_{w}") for w in WEIGHTS])
        # the segment after `segment`, where its coin is less than those on both sides
        out = stored(rows.join(ahead, "next").where((coin("next") < coin("segment")) & ((F.col("then") == END) | (coin("next") < coin("then"))))
                     .select("segment", F.col("next").alias("gone"), "then", *WEIGHTS, *[f"n_{w}" for w in WEIGHTS]), "taken")
        stay = rows.join(out.select(F.col("gone").alias("segment")), "segment", "left_anti")
        merged = stay.join(out.select("segment", "then", *[f"n_{w}" for w in WEIGHTS]), "segment", "left").select(
            "segment", F.coalesce("then", "next").alias("next"), *[(F.col(w) + F.coalesce(f"n_{w}", F.lit(0))).alias(w) for w in WEIGHTS])
        rows = stored(merged, "list")
        taken.append(out)
        turn += 1
    places = stored(rows.coalesce(1).mapInArrow(_rank_rest, schema), "places")
    for out in reversed(taken):
        back = out.select("segment", "gone", *[F.col(w).alias(f"o_{w}") for w in WEIGHTS]).join(places, "segment").select(
            F.col("gone").alias("segment"), *[(F.col(w) + F.col(f"o_{w}")).alias(w) for w in WEIGHTS])
        places = stored(places.unionByName(back), "places")
    return places


def _subtrees(tree: DataFrame, rest: int) -> DataFrame:
    """(nid, enter_at, leave_at, n_leaves, saved_tokens) for a stored tree (nid, parent, child, sibling,
    leaf, saved); -1 stands for none."""
    spark = tree.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tree.count() // BLOCK + 1)
    arcs = stored(tree.repartitionByRange(parts, "nid").sortWithinPartitions("nid").mapInArrow(_segments, SEGMENTS), "arcs")
    ends = [arcs.where(f"{name}_next IS NOT NULL").select(F.col(f"{name}_segment").alias("segment"), F.col(f"{name}_next").alias("next"),
                                                          *[F.col(f"{name}_{w}").alias(w) for w in WEIGHTS]) for name in ("enter", "leave")]
    places = list_rank(ends[0].unionByName(ends[1]), rest)
    for name in ("enter", "leave"):
        arcs = arcs.join(places.select(F.col("segment").alias(f"{name}_segment"), *[F.col(w).alias(f"{name}_0_{w}") for w in WEIGHTS]), f"{name}_segment")
    at = lambda name, w: F.col(f"{name}_{w}") + F.col(f"{name}_0_{w}")
    found = arcs.join(tree.select("nid", "leaf", "saved"), "nid")
    return found.select("nid", (at("enter", "steps") - 1).alias("enter_at"), (at("leave", "steps") - 1).alias("leave_at"),
                        (at("leave", "leaves") - at("enter", "leaves") + F.col("leaf")).alias("n_leaves"),
                        (at("leave", "saved") - at("enter", "saved") + F.col("saved")).alias("saved_tokens"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the same node that follow each other, comma-joined."""
    for batch in batches:
        nid, conv = batch.column("nid").to_numpy(), batch.column("conv_id").to_numpy()
        if len(nid):
            cut = np.flatnonzero(np.diff(nid)) + 1
            yield pa.record_batch({"nid": nid[np.r_[0, cut]], "first": conv[np.r_[0, cut]],
                                   "ids": [",".join(map(str, x.tolist())) for x in np.split(conv, cut)]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined runs of each node, as they come; only the state of one node is held."""
    node, state = None, None
    for batch in batches:
        nodes, sums = [], []
        for nid, ids in zip(batch.column("nid").to_pylist(), batch.column("ids").to_pylist()):
            if nid != node:
                if node is not None:
                    nodes.append(node)
                    sums.append(state.hexdigest())
                node, state = nid, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.record_batch({"nid": pa.array(nodes, pa.int64()), "ends_sha256": pa.array(sums, pa.string())})
    if node is not None:
        yield pa.record_batch({"nid": pa.array([node], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def _ends(prefixes: DataFrame, sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nid, ends_sha256) of nodes at which conversations end. Ids are joined range by range first, so the
    task that sees all of a node reads a row per some thousand ids."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = prefixes.join(sizes, "conv_id").where("depth = size").select("conv_id", "depth", "k1", "k2")
    bare = sizes.where("size = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2")])
    ends = whole.unionByName(bare).join(nodes.select("nid", "depth", "k1", "k2"), ["depth", "k1", "k2"]).select("nid", "conv_id")
    runs = ends.repartitionByRange(parts, "nid", "conv_id").sortWithinPartitions("nid", "conv_id").mapInArrow(_runs, "nid long, first long, ids string")
    return runs.repartition(parts, "nid").sortWithinPartitions("nid", "first").mapInArrow(_digests, "nid long, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame, rest: int = REST) -> DataFrame:
    """A row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the places enter_at and leave_at of its arcs in the tour.

    turns: (conv_id, position, one, two, words), positions from 0 without gaps; sizes: (conv_id, size)
    of every conversation, those without turns too. Without conversations there is no node."""
    prefixes, sizes = stored(_prefixes(turns), "prefixes"), stored(sizes, "sizes")
    nodes = _nodes(prefixes, sizes)
    above = nodes.select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                         (F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    below = nodes.where("depth > 0").select("nid", "depth", "u1", "u2").join(above, ["depth", "u1", "u2"]).select("nid", "parent", "parent_conv_id")
    kin = stored(running(below, ["parent"], ["nid"], lead="nid").drop("_at"), "kin")
    families = kin.groupBy(F.col("parent").alias("nid")).agg(F.min(F.col("nid")).alias("child"), F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    none = F.lit(END).cast("long")
    tree = stored(nodes.select("nid", "conv_id", "depth", "n_convs", saved.alias("saved"))
                  .join(kin.select("nid", "parent", "parent_conv_id", F.col("_next").alias("sibling")), "nid", "left")
                  .join(families, "nid", "left").select(
                      "nid", "conv_id", "depth", "parent_conv_id", "n_convs", "saved", F.coalesce("parent", none).alias("parent"),
                      F.coalesce("sibling", none).alias("sibling"), F.coalesce("child", none).alias("child"),
                      F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                      F.col("n_children").isNull().cast("long").alias("leaf")), "tree")
    sums = _subtrees(tree.select("nid", "parent", "child", "sibling", "leaf", "saved"), rest)
    return (tree.join(sums, "nid").join(_ends(prefixes, sizes, nodes), "nid", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "enter_at", "leave_at"))


def conversation_trie(conversations: DataFrame, rest: int = REST) -> DataFrame:
    """The trie of the rebuilt conversations (`rebuild`) of (conv_id, turn, role, text).

    Turns are in order of turn (nulls first), then role, then a hash of the text; repeated rows are
    repeated turns, null roles and texts are empty. Rows without a conv_id are turns of no conversation.
    Other columns are not read. An empty table has no node."""
    return prefix_trie(*rebuild(turn_table(conversations)), rest)


# The same for DuckDB: prefixes as texts, subtrees by the prefixes of every node's least member. CRC-32 bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) - 1 AS position, role, body FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS id FROM p GROUP BY conv_id),
s AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ord(id[i])::BIGINT)),
             lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))),
             4294967295::BIGINT) % 4 AS h
  FROM c),
q AS (SELECT s.*, least(h, coalesce(o.n, 0)) AS b FROM s LEFT JOIN (SELECT conv_id AS o_id, n FROM c) o ON o.o_id = s.base),
r AS (
  SELECT q.conv_id, p.position + 1 AS depth, role, body FROM q JOIN p ON p.conv_id = q.base AND p.position < q.b
  UNION ALL
  SELECT q.conv_id, p.position - h + b + 1, role, body FROM q JOIN p ON p.conv_id = q.conv_id AND p.position >= h),
z AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM q
  UNION ALL
  SELECT conv_id, depth, string_agg(sha256(sha256(role) || body), ',') OVER (PARTITION BY conv_id ORDER BY depth),
         len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) FROM r),
y AS (SELECT conv_id, max(depth) AS size FROM z GROUP BY conv_id),
n AS (
  SELECT depth, prefix, min(z.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         sha256(coalesce(string_agg(z.conv_id::VARCHAR, ',' ORDER BY z.conv_id) FILTER (depth = size), '')) AS ends_sha256
  FROM z JOIN y ON y.conv_id = z.conv_id GROUP BY depth, prefix),
u AS (
  SELECT v.conv_id, v.depth, a.depth AS a_depth, a.conv_id AS a_conv, v.saved
  FROM n v JOIN z ON z.conv_id = v.conv_id AND z.depth <= v.depth JOIN n a ON a.depth = z.depth AND a.prefix = z.prefix),
k AS (SELECT conv_id, depth, a_conv AS parent_conv_id FROM u WHERE a_depth = depth - 1),
f AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM k GROUP BY 1, 2),
w AS (
  SELECT a_conv, a_depth, sum(u.saved) AS saved_tokens, count(*) FILTER (f.n_children IS NULL) AS n_leaves
  FROM u LEFT JOIN f ON f.parent_conv_id = u.conv_id AND f.depth = u.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, k.parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, w.n_leaves,
       w.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth
LEFT JOIN f ON f.parent_conv_id = n.conv_id AND f.depth = n.depth
JOIN w ON w.a_conv = n.conv_id AND w.a_depth = n.depth"""
