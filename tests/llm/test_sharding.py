import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from labelaudit.llm import sharding as sh


def check_places(rows, shards):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(shards))
    for got in places.values():
        assert sorted(got) == list(range(len(got)))


def test_shard_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sh.shard_documents(docs, 8).collect()
    want = {(d.doc_id, len(d.text.encode()) + 16, zlib.crc32(d.text.encode())) for d in docs.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == want and len(rows) == len(want)
    check_places(rows, 8)
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.02 * sum(loads.values()) / 8
    assert min(loads.values()) >= 0.98 * sum(loads.values()) / 8


def test_edge_cases(messy, nothing):
    rows = sh.shard_documents(messy, 40).collect()
    assert len(rows) == messy.count()
    check_places(rows, 40)
    assert sh.shard_documents(nothing, 40).count() == 0


def test_one_id_with_most_rows_is_split(spark):
    docs = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("same text").alias("text"))
    rows = sh.shard_documents(docs, 10).collect()
    check_places(rows, 10)
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 10


def test_edited_maps_move_little(spark, sf, tmp_path):
    records = sh.slot_records(spark.read.parquet(f"{sf}/documents.parquet"), 512)
    loads = sh.slot_loads(records, 8)
    sh.save_map(sh.edit_map(loads, 8), str(tmp_path / "maps"))
    first = sh.load_map(spark, str(tmp_path / "maps"))
    sh.save_map(sh.edit_map(loads, 9, first, version=2), str(tmp_path / "maps"))
    second = sh.load_map(spark, str(tmp_path / "maps"))
    assert {r.version for r in second.collect()} == {2} and sh.load_map(spark, str(tmp_path / "maps"), 1).count() == first.count()
    a = {(r.virtual_slot, r.part): (r.shard, r.bytes) for r in first.collect()}
    b = {(r.virtual_slot, r.part): (r.shard, r.bytes) for r in second.collect()}
    moved = sum(a[k][1] for k in b if k in a and a[k][0] != b[k][0])
    total = sum(x[1] for x in b.values())
    assert moved < 0.25 * total
    sums = defaultdict(int)
    for shard, size in b.values():
        sums[shard] += size
    assert len(sums) == 9 and max(sums.values()) < 1.1 * total / 9
    gone = {(r.virtual_slot, r.part): r.shard for r in sh.edit_map(loads, 7, first, version=2).collect()}
    assert set(gone.values()) == set(range(7))
