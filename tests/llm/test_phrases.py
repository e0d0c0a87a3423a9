import random
import re
from collections import Counter

import pytest

from labelaudit.llm import phrases as ph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, most=3, least=10, cover=50, top=2000):
    """Every phrase counted, in plain whole numbers."""
    count = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            count[lang, ()] += len(words)
            for size in range(1, most + 1):
                count.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    fit = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, words), a in fit.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                longer[lang, words[i:i + size]] = max(a, longer[lang, words[i:i + size]])
    out = []
    for (lang, words), a in fit.items():
        cuts = [(1000000 * a * a // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if 100 * longer[lang, words] < cover * a:
            out.append((lang, " ".join(words), a, count[lang, words[:k]], count[lang, words[k:]], count[lang, ()], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    ranked = []
    for lang, phrase, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, *rest))
    return sorted(ranked)


def make(rng, n):
    words = [rng.choice("abcdefgh") + "é日x"[rng.randrange(3)] * rng.randrange(3) for _ in range(30)]
    fixed = [" ".join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(12)]
    docs = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(12)):
            text += rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words + ["Rare%d" % rng.randrange(999)])
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r\n", "?!"])
        docs.append((rng.choice(["en", "en", "de", None]), text.upper() if rng.random() < 0.2 else text))
    return docs


def got(df, **more):
    return sorted(tuple(r) for r in ph.collocations(df, **more).collect())


@pytest.mark.parametrize("seed,more", [(1, {}), (2, {"most": 5, "least": 4, "cover": 80}), (3, {"top": 5})])
def test_against_brute_force(spark, seed, more):
    docs = make(random.Random(seed), 400)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = brute(docs, **more)
    assert want and got(df, **more) == want


def test_border_failures_lead_to_further_passes(spark):
    """With a sample that proposes next to nothing, passes go on until all is counted; with one that
    proposes all, one is enough. The result is the same."""
    docs = make(random.Random(4), 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4).cache()
    few, passes = ph.frequent_phrases(df, 4, 4, proposing=10**9)
    assert passes == 4                       # words, pairs, triples, quadruples
    all_, one = ph.frequent_phrases(df, 4, 4, sample=1, proposing=1)
    assert one == 1
    some, middle = ph.frequent_phrases(df, 4, 4)
    assert 1 < middle <= 4
    rows = [sorted(map(tuple, x.collect())) for x in (few, all_, some)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(set(r[:3] for r in rows[0]))
    df.unpersist()


def test_messy_rows(spark, messy, nothing):
    """Null, empty and very long texts, repeated rows, columns named as the operator's own."""
    docs = [(r.lang, r.text) for r in messy.collect()]
    assert got(messy, least=2) == brute(docs, least=2)
    assert got(nothing) == []
    big = spark.createDataFrame([("en", "a b " * 200_000, "x", 1), (None, "q w. " * 50, "y", 2), ("en", None, "z", 3)],
                                "lang string, text string, phrase string, n int")
    assert got(big) == brute([(r.lang, r.text) for r in big.collect()])


def test_scores_past_64_bits(spark):
    """a * a * 1000000 goes beyond a long."""
    n = 4_000_000
    assert n * n * 10**6 > 2**63
    counts = spark.createDataFrame([("en", 0, "", 2 * n), ("en", 1, "a", n), ("en", 1, "b", n + 1), ("en", 2, "a b", n)], ph.COUNTED)
    before, ph.frequent_phrases = ph.frequent_phrases, lambda *_: (counts, 1)
    try:
        assert got(counts) == [("en", 1, "a b", n, n, n + 1, 2 * n, 10**6 * n * n // (n * (n + 1)))]
    finally:
        ph.frequent_phrases = before
