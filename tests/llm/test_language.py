import zlib

from labelaudit.llm import language as lg


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lg.identify_documents(docs).collect()}
    truth = [d for d in docs.collect() if d.lang]
    assert len(rows) == docs.count()
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in truth)
    for split in (True, False):
        own = [d for d in truth if rows[d.doc_id].held_out == split]
        assert sum(rows[d.doc_id].lang_pred == d.lang for d in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_calibration_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.fit(docs)
    assert 0 < model.threshold <= 0.5 and model.languages == ["de", "en", "es", "fr"]
    pred = lg.identify(docs, model, ["doc_id", "lang"])
    from pyspark.sql import functions as F
    gone = pred.where(model.rejects(F.col("lang_pred"), F.col("score"))).count()
    assert gone <= 0.01 * docs.count()
    mean, right = pred.agg(F.avg("score"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert abs(mean - right) < 0.05


def test_edge_cases(messy, nothing):
    rows = lg.identify_documents(messy).collect()
    assert len(rows) == messy.count()
    for r, d in zip(sorted(rows, key=str), sorted(messy.collect(), key=str)):
        assert r.lang_pred in ("en", "und")
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (1, 2, 3, 9))
    assert by_id[6].lang_pred == "en"
    assert lg.identify_documents(nothing).count() == 0
    unlabelled = messy.withColumn("lang", messy.lang.substr(100, 1)).where("lang is null")
    assert {r.lang_pred for r in lg.identify_documents(unlabelled).collect()} <= {"und"}


def test_subwords_match_plain_python():
    vocabulary = ["a", "haus", "été", "x" * 40]
    owner, bucket = lg.subwords(vocabulary)
    n = [sum(max(0, len(w) + 2 - s + 1) for s in lg.SIZES) for w in vocabulary]
    assert [int((owner == k).sum()) for k in range(len(vocabulary))] == n
    alone = [sorted(lg.subwords([w])[1].tolist()) for w in vocabulary]
    assert [sorted(bucket[owner == k].tolist()) for k in range(len(vocabulary))] == alone


def test_chunks_cover_everything():
    texts = ["a" * 10, None, "b" * 3_000_000, "", "c"]
    parts = list(lg.chunks(texts))
    assert [k for p in parts for k in range(p.start, p.stop)] == list(range(5))


def test_null_ids_are_learned_from_and_large_ids_kept(spark):
    said = {"en": "the old house by the river was sold again this year", "de": "das alte haus am fluss wurde dieses jahr wieder verkauft"}
    rows = [(None, f"{said[lang]} {k}", lang) for k in range(300) for lang in said] + [(None, said["en"], "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    right = [r.lang == r.lang_pred for r in lg.identify(docs, lg.fit(docs), ["lang"]).collect()]
    assert sum(right) > 0.97 * len(rows)
    ids = [2**60 + 1, 2**60 + 3, -2**63, None]
    few = spark.createDataFrame([(d, said["en"], "en") for d in ids], "doc_id long, text string, lang string").coalesce(1)
    assert sorted((r.doc_id for r in lg.identify_documents(few).collect()), key=str) == sorted(ids, key=str)
