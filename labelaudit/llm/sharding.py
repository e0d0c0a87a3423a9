"""Sharding by fixed virtual slots.

A record's id is hashed into one of `SLOTS` virtual slots, which never changes. Bytes are summed per
slot, and a small versioned table says which shard holds which slot. Rebalancing, more shards or
fewer edits that table: slots within a shard's fair share stay where they are, and only the rest
moves. Everything the table needs is a few thousand rows, whatever the corpus."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored

SLOTS = 8192
PARTS = 32                   # pieces of a slot that alone is over an eighth of a shard
HEAVY = 8
OVERHEAD = 16                # bytes of a record besides its text


def slot_records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, lot): one row per record, without its text, stored
    once. A null text is empty. `lot` tells repeated rows apart."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return stored(documents.select(
        "doc_id", (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("lot")), "slots")


def slot_loads(records: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, part, bytes, rows). A slot of over an eighth of a shard (one id repeated in
    many rows; at most 8 x shards such slots) is split by `lot` into parts; the part is -1 else."""
    cells = (records.groupBy("virtual_slot", F.pmod("lot", F.lit(PARTS)).cast("int").alias("part"))
             .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    slots = cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("slot_bytes"))
    total = slots.agg(F.sum("slot_bytes").alias("total"))
    heavy = (slots.join(F.broadcast(total)).where(F.col("slot_bytes") * (shards * HEAVY) > F.col("total"))
             .select("virtual_slot", F.lit(True).alias("heavy")))
    part = F.when(F.coalesce("heavy", F.lit(False)), F.col("part")).otherwise(-1)
    return (cells.join(heavy, "virtual_slot", "left").groupBy("virtual_slot", part.alias("part"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))


def edit_map(loads: DataFrame, shards: int, before: DataFrame | None = None, version: int = 1,
             slack: float = 0.001) -> DataFrame:
    """(version, virtual_slot, part, bytes, rows, shard): the map for `loads`.

    With the map `before`, a slot keeps its shard while the shard's slots, largest first, stay within
    the mean load times 1 + `slack`; the others, and those of shards that are gone, are free. Free
    slots go, largest first, to the shard with the least bytes. An array fold does that: it holds one
    load per shard and runs over at most a few thousand slots."""
    if before is None:
        old = loads.withColumn("shard", F.lit(None).cast("int"))
    else:
        old = loads.join(before.select("virtual_slot", "part", "shard"), ["virtual_slot", "part"], "left")
        old = old.withColumn("shard", F.when(F.col("shard") < shards, F.col("shard")))
    fair = loads.agg((F.sum("bytes") / shards * (1 + slack)).alias("fair"))
    full = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot", "part")
    marked = old.join(F.broadcast(fair)).withColumn(
        "stays", F.col("shard").isNotNull() & (F.sum("bytes").over(full) <= F.col("fair")))
    unit = F.struct(F.col("bytes").alias("bytes"), "virtual_slot", "part", "rows")
    folded = marked.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), unit)), asc=False).alias("free"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept"))
    folded = folded.withColumn("loads", F.expr(
        f"transform(sequence(0, {shards - 1}), i -> aggregate(filter(kept, k -> k.shard = i), 0L, (a, k) -> a + k.bytes))"))
    folded = folded.withColumn("fold", F.expr("""
        aggregate(free,
          named_struct('loads', loads, 'k', int(array_position(loads, array_min(loads)) - 1), 'picks', cast(array() AS array<int>)),
          (s, u) -> transform(array(transform(s.loads, (l, i) -> if(i = s.k, l + u.bytes, l))), n ->
            named_struct('loads', n, 'k', int(array_position(n, array_min(n)) - 1), 'picks', concat(s.picks, array(s.k))))[0])"""))
    moved = (folded.select(F.explode(F.arrays_zip(F.col("free"), F.col("fold.picks").alias("shard"))).alias("x"))
             .select("x.free.virtual_slot", "x.free.part", "x.free.bytes", "x.free.rows", "x.shard"))
    stay = marked.where("stays").select("virtual_slot", "part", "bytes", "rows", "shard")
    return stay.unionByName(moved).select(F.lit(version).alias("version"), "virtual_slot", "part", "bytes", "rows", "shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds the map's version to the maps at `path`; an earlier version is never touched."""
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, by default the latest."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """`records` with their shard and their place in it, gapless from 0 (`slot`): the rows of the
    shard's earlier slots, and the row's rank by id in its own. The map is broadcast; its size is
    bounded by the number of slots."""
    inside = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select(F.col("virtual_slot").alias("_slot"), "part", "shard",
                            F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("_base"))
    here = records.join(F.broadcast(bases), (F.col("virtual_slot") == F.col("_slot")) & (
        (F.col("part") == -1) | (F.col("part") == F.pmod("lot", F.lit(PARTS)))))
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "lot")
    return here.withColumn("slot", F.col("_base") + F.row_number().over(order) - 1).drop("_slot", "_base")


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null:
    growing moves whole slots by the map), virtual_slot, version. An empty table gives no rows; null
    ids share a slot, which is split when it is heavy."""
    records = slot_records(documents)
    slot_map = stored(edit_map(slot_loads(records, shards), shards), "slot_map")
    return place(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("version"))
