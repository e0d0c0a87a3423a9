import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from labelaudit.llm import line_runs as lr


def brute(docs, least):
    """Texts without the lines that later copies of runs of `least` words or more cover; every run
    of every length is looked at."""
    split = [re.split(r"\n(?=[^\S\n]*\S)", t) if t and t.strip() else [] for _, t in docs]
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, k))
    seen, gone = {}, defaultdict(set)
    for k in order:
        lines = split[k]
        for i in range(len(lines)):
            run, words = [], 0
            for j in range(i, len(lines)):
                run.append(lines[j].rstrip())
                words += len(lines[j].split())
                if words >= least and seen.setdefault(tuple(run), (k, i)) != (k, i):
                    gone[k] |= set(range(i, j + 1))
    return [(d, t if not gone[k] else "\n".join(x for i, x in enumerate(split[k]) if i not in gone[k]), len(split[k]), len(gone[k]))
            for k, (d, t) in enumerate(docs)]


def make(rng):
    line = [" ".join(rng.choices("abcdefg", k=rng.randrange(1, 7))) for _ in range(25)]
    runs = [[rng.choice(line) for _ in range(rng.randrange(1, 9))] for _ in range(6)]
    docs = []
    for k in range(60):
        body = []
        for _ in range(rng.randrange(6)):
            body += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(line) + str(rng.randrange(9))]
            if rng.random() < 0.3:
                body += rng.choice([["", "  "], [" \t" + rng.choice(line)], [rng.choice(line)] * rng.randrange(12)])
        docs.append((k, "\n".join(body)))
    return docs


def got(df, docs, least):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lr.drop_repeated_lines(df, least).collect()), key=str)


def test_against_brute_force(spark):
    for seed, least in ((1, 4), (2, 9), (3, 20), (4, 1)):
        docs = make(random.Random(seed)) + [(90, None), (91, ""), (92, " \n "), (None, "a b c d e f g h i j"), (93, "a b c d e f g h i j")]
        df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lot int, n_lines int").coalesce(1)
        assert got(df, docs, least) == sorted(brute(docs, least), key=str)


def test_edge_cases(messy, nothing):
    rows = lr.drop_repeated_lines(messy).collect()
    assert len(rows) == messy.count() and set(messy.columns) <= set(rows[0].asDict())
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[1] is None and by_id[2] == "" and by_id[4] and by_id[5] == "" and by_id[11] == "one"
    assert lr.drop_repeated_lines(nothing).count() == 0


def test_real_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text.count("\n") < 150]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(df, docs, 50) == sorted(brute(docs, 50), key=str)


def test_texts_that_lose_nothing_are_not_moved(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("_lot"), F.repeat(F.lit("some words "), 500).alias("text"))
    rows.write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([(3, [0]), (7, [1, 2])], "_lot long, _gone array<int>").write.parquet(str(tmp_path / "gone"))
    found = lr.with_gone(*(spark.read.parquet(str(tmp_path / name)) for name in ("rows", "gone")))
    got = {r._lot: r._gone for r in found.select("_lot", "_gone").collect()}
    assert found.count() == 400 and len(got) == 400 and {k: v for k, v in got.items() if v} == {3: [0], 7: [1, 2]}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the sides of the join move; the texts that lose nothing reach the union as they are read
    assert "Union" in plan and plan.count("Exchange hashpartitioning(_lot") == 2
