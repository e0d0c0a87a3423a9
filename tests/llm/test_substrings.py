import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from labelaudit.llm import substrings as ss
from labelaudit.llm import texts as tx

LAST = float("inf")


def brute(docs):
    """By a table of every string of 50 bytes and the least document it begins in."""
    bodies = [(t or "").encode() for _, t in docs]
    order = [LAST if d is None else d for d, _ in docs]
    first = {}
    for k, body in enumerate(bodies):
        for i in range(len(body) - 49):
            first[body[i:i + 50]] = min(first.get(body[i:i + 50], LAST), order[k])
    out = []
    for k, body in enumerate(bodies):
        gone = np.zeros(len(body), bool)
        for i in range(len(body) - 49):
            if first[body[i:i + 50]] < order[k]:
                gone[i:i + 50] = True
        kept = bytes(np.frombuffer(body, "uint8")[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((docs[k][0], len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(rng, n=60):
    words = [f"{c}{k}é" for c in "abc" for k in range(12)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(8, 60))) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randrange(25))))
        text = rng.choice([" ", "", "x"]).join(parts)
        if rng.random() < 0.3:
            text = text[rng.randrange(len(text) + 1):]
        docs.append((k, text))
    return docs + [(200, "z" * 300), (201, "z" * 120), (202, docs[3][1]), (203, docs[3][1]), (204, None), (205, ""), (206, "y" * 49),
                   (207, "y" * 50), (208, "y" * 51), (None, docs[3][1]), (None, passages[0]), (203, passages[1]), (3, passages[2])]


def got(df):
    return sorted((tuple(r) for r in ss.remove_repeats(df).drop("kept").collect()), key=str)


@pytest.mark.parametrize("seed,many", [(1, 2000), (2, 2000), (3, 1)])
def test_against_every_string(spark, seed, many, monkeypatch):
    monkeypatch.setattr(ss, "MANY", many)
    docs = make(random.Random(seed))
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, doc int, tag int, key int").repartition(6)
    assert got(df) == brute(docs)


def test_real_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_edge_cases(messy, nothing):
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert got(messy) == brute(docs)
    assert ss.remove_repeats(nothing).count() == 0
    kept = {r.doc_id: r.kept for r in ss.remove_repeats(messy).collect()}
    assert bytes(kept[11]) == b"one" and bytes(kept[5]) == b""


def test_equal_strings_are_grouped_in_order():
    rng = random.Random(3)
    base = [bytes(rng.choices(b"ab", k=50)) for _ in range(20)]
    strings = []
    for _ in range(400):
        s = bytearray(rng.choice(base))
        if rng.random() < 0.5:
            s[rng.choice([0, 5, 23, 24, 25, 40, 49])] = rng.choice(b"abz")
        strings.append(bytes(s))
    groups = ss.equal_strings(np.frombuffer(b"".join(strings), "uint8").reshape(-1, 50))
    keys = [strings[g[0]] for g in groups]
    assert keys == sorted(keys) and all(len({strings[i] for i in g}) == 1 for g in groups)
    assert {k: sorted(g.tolist()) for k, g in zip(keys, groups)} == {
        k: [i for i, s in enumerate(strings) if s == k] for k in set(strings) if strings.count(k) > 1}


def test_every_string_has_one_anchor():
    texts = ["ab" * 60, "", "x" * 49, "the quick brown fox " * 9]
    data, offsets = tx.raw(pa.array(texts))
    doc, key, context, first, back, more = ss.anchors(data, offsets, tx.Powers(tx.BASE))
    begins = sorted((d, f + i) for d, f, m in zip(doc, first, more) for i in range(m + 1))
    assert begins == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]
    assert (back >= 0).all() and (back < ss.SPAN).all() and (more < ss.SPAN).all()


def test_rows_of_one_id_lose_only_their_own_bytes(spark):
    rng = random.Random(12)
    words = [f"{c}{k}" for c in "abcdefgh" for k in range(60)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage = text(30)
    docs = [(1, f"{text(9)} {passage} {text(9)}")]
    for owner in (5, None):
        docs += [(owner, f"{text(20)} {passage}" if k % 2 else text(50)) for k in range(400)]
    got_rows = got(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert got_rows == brute(docs)
