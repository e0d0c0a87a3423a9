"""Counting grams in arrays against a plain count, at any piece size."""
from collections import Counter

import pytest

from labelaudit.operators import features as ft, ngrams as ng

ROWS = [(1, "a", "The cat  sat\ton the THE mat"), (1, "b", None), (2, "a", ""), (2, "b", "x"), (3, "a", "été été 日本語   wide"),
        (3, "b", "cat " * 500), (3, "b", "cat " * 500)]


def counts(text, lo=2, hi=4):
    return Counter(g for w in (text or "").lower().split() for g in ng.gram_list(w, lo, hi))


@pytest.mark.parametrize("cells,known", [(1 << 21, 1 << 17), (3, 2)])
def test_grams_of_rows(spark, monkeypatch, cells, known):
    monkeypatch.setattr(ng, "CELLS", cells)
    monkeypatch.setattr(ng, "KNOWN_WORDS", known)
    df = spark.createDataFrame(ROWS, "id long, view string, text string").coalesce(1)
    got = ng.char_ngrams(df, keys=("id", "view")).collect()
    want = sorted((i, v, g, n) for i, v, t in ROWS for g, n in counts(t).items())
    assert sorted(map(tuple, got)) == want
    vocabulary = sorted({g for _, _, g, _ in want})[::3] + ["none"]
    rows = ng.row_vectors(df, vocabulary, keys=("id", "view")).collect()
    assert [(r.id, r.view) for r in rows] == [r[:2] for r in ROWS]
    for r, (_, _, text) in zip(rows, ROWS):
        own = counts(text)
        assert dict(zip(r.idx, r.val)) == {i: own[g] for i, g in enumerate(vocabulary) if own[g]}
        assert r.idx == sorted(r.idx)


def test_words_as_spark_makes_grams(spark):
    """`gram_list` is `word_grams`."""
    from pyspark.sql import functions as F
    words = ["a", "ab", "abc", "日本", "x" * 9]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for lo, hi in ((2, 4), (1, 3), (4, 5), (3, 3)):
        got = {r.w: r.g for r in df.select("w", ng.word_grams(F.col("w"), lo, hi).alias("g")).collect()}
        assert {w: Counter(g) for w, g in got.items()} == {w: Counter(ng.gram_list(w, lo, hi)) for w in words}


def test_features_without_manual_counts_or_terms(spark):
    rows = [(i, '{"a": "%s"}' % ("b" * (i % 5)), "{}") for i in range(30)] + [(99, "", None)]
    df = spark.createDataFrame(rows, "id long, headers string, request string").repartition(3)
    for use_manual, width in ((True, 7), (False, 3)):
        out = ft.Preprocessor(svd_dim=3, max_features=20, use_manual=use_manual).fit_transform(df).collect()
        assert sorted(r.id for r in out) == sorted(r[0] for r in rows) and {len(r.features) for r in out} == {width}
