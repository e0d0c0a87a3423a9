import corpus_pipeline as cp
from labelaudit.llm import language
from labelaudit.session import stored
from tests.llm import test_decontaminate, test_jaccard_join, test_line_runs, test_packing


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stored(cp.known_language(spark, docs, sf))
    model = language.fit(docs)
    want = []
    for d in docs.collect():
        name, score = (x[0] for x in model.predict([d.text]))
        if name != "und" and score >= model.threshold:
            want.append(d.doc_id)
    assert ids(kept) == sorted(want) and kept.columns == docs.columns and len(want) > 0.99 * docs.count()

    cut = stored(cp.no_repeated_lines(spark, kept, sf))
    short = [(r.doc_id, r.text) for r in kept.collect()]
    if max(t.count("\n") for _, t in short) < 400:
        texts = {d: t for d, t, _, _ in test_line_runs.brute(short, 50) if t.strip()}
        assert {r.doc_id: r.text for r in cut.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = stored(cp.one_of_each_group(spark, cut, sf))
    rows = test_jaccard_join.brute([(r.doc_id, r.text) for r in cut.collect()])
    assert ids(single) == sorted({c for _, _, c in rows})

    clean = stored(cp.no_benchmark(spark, single, sf))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [r.doc_id for r in single.collect() if not any(test_decontaminate.brute(r.text, i) for i in items)]
    assert ids(clean) == sorted(want) and len(want) < single.count()

    used, least = test_packing.check_packing(clean.collect(), cp.packed(spark, clean, sf).collect(), 2048)
    assert used <= 1.01 * least + 1


def test_row_numbers_outlast_another_split_of_the_files(spark, tmp_path):
    from labelaudit.llm import line_runs
    line = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{line}\nown {k}", "en", "s", 10) for k in range(4)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, cp.COLUMNS).coalesce(1).write.parquet(path)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(size), spark.conf.get(cost)
    docs = spark.read.parquet(path)
    try:
        single, cut = cp.one_of_each_group(spark, docs, None), line_runs.drop_repeated_lines(docs)
        spark.conf.set(size, "20")            # the file's rows are now in another of its splits
        spark.conf.set(cost, "1")
        assert ids(single) == [0]
        assert sorted((r.doc_id, r.n_removed) for r in cut.collect()) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    finally:
        spark.conf.set(size, before[0])
        spark.conf.set(cost, before[1])


def test_edge_cases(spark, messy, nothing, sf):
    for name, stage in cp.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name
    docs = messy.select(cp.COLUMNS)
    for name, stage in cp.STAGES[1:-1]:
        assert stage(spark, docs, sf).columns == cp.COLUMNS, name
    left = cp.one_of_each_group(spark, messy, sf).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 2, 3, 4, 6, 9, 10, 11, 12, 14, 15] or len(left) == 13


def test_run(spark, sf):
    rows = cp.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_tables_of_a_stage_go_when_it_ends(spark, sf, monkeypatch):
    import os

    from labelaudit import session
    monkeypatch.setattr(session, "scratch_path", lambda s, name, make=session.scratch_path: made.append(make(s, name)) or made[-1])
    made = []
    rows = cp.run(spark, sf).count()
    named = lambda *names: [p for p in made if os.path.basename(p).split("-")[0] in names]
    early = named("lines", "ranks", "runs", "signatures", "elements")
    assert rows > 0 and len(early) > 8 and not any(os.path.exists(p) for p in early)
    assert all(os.path.exists(p) for p in named("numbered", "gone", "losers", *[name for name, _ in cp.STAGES[:-1]]))


def test_rows_are_told_apart_without_a_copy_of_the_documents(spark, sf, monkeypatch):
    import os

    from labelaudit import session
    monkeypatch.setattr(session, "scratch_path", lambda s, name, make=session.scratch_path: made.append(make(s, name)) or made[-1])
    made = []
    para = "the quick brown fox jumps over the lazy dog near the old stone bridge at noon"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, para), (None, para), (None, "alone here " * 9), (None, "alone here " * 9), (None, item), (3, "x y z"), (3, "x y z"),
            (3, "other words"), (2, "x y z"), (4, "u v w"), (4, "u v w"), (5, para + " again"), (6, None), (6, None), (7, ""), (7, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in cp.one_of_each_group(spark, docs, sf).collect()]
    want = [(None, "alone here " * 9), (None, item), (2, "x y z"), (3, "other words"), (4, "u v w"), (5, para + " again"),
            (6, None), (6, None), (7, ""), (7, "")]
    assert sorted(left, key=str) == sorted(want, key=str)
    clean = [(r.doc_id, r.text) for r in cp.no_benchmark(spark, docs, sf).collect()]
    assert sorted(clean, key=str) == sorted([r for r in rows if r[1] != item], key=str)
    assert not any(os.path.basename(p).startswith("numbered-") for p in made)
