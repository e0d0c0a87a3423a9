import hashlib
import random

import numpy as np
import pytest

from labelaudit.llm import syncmers as sm


def brute(text):
    """Places of closed syncmers by the definition."""
    codes = np.array([ord(c) for c in text], "uint64")
    out = []
    for i in range(len(text) - sm.K + 1):
        inner = [sm._runs(codes[i + j:i + j + sm.S], None, sm.S)[0] for j in range(sm.K - sm.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_by_definition_and_context_free():
    rng = random.Random(2)
    for _ in range(15):
        text = "".join(rng.choices("abcé ", k=rng.randrange(120)))
        codes = np.array([ord(c) for c in text], "uint64")
        assert sm.closed_syncmers(codes).tolist() == brute(text)
    a, b = "lorem ipsum dolor sit amet consectetur " * 2, "x" * 37
    inside = [i + 37 for i in brute(a)]
    assert set(inside) <= set(brute(b + a))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    for k, r in enumerate(rows):
        text, after = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(text) // 2
        yield r, text, after, text[:len(text) - half] + after[:half]


@pytest.mark.parametrize("partitions", [1, 7, 400])
def test_whole_table(spark, sf, partitions):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in sm.fingerprint_documents(docs, partitions).collect()}
    assert len(got) == docs.count()
    unlike, halves = [], []
    for r, text, after, edited in expected(docs.collect()):
        out = got[r.doc_id]
        assert out.n_chars == len(text)
        assert out.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (out.fingerprint, out.edited_fingerprint) == (sm.fingerprint(text), sm.fingerprint(edited))
        assert out.near_next == sm.likeness(sm.anchors(text), sm.anchors(after))
        if len(text) > 400:
            halves.append(out.near_edited)
            unlike.append(out.near_next)
    assert np.median(unlike) < 0.05 and 0.35 < np.median(halves) < 0.65


def test_edge_cases(messy, nothing):
    rows = sm.fingerprint_documents(messy, 4).collect()
    assert len(rows) == messy.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].fingerprint == by_id[7].fingerprint and by_id[1].fingerprint == "" == by_id[2].fingerprint
    assert sm.fingerprint_documents(nothing, 4).count() == 0
    alone = sm.fingerprint_documents(messy.where("doc_id = 6"), 4).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert sm.fingerprint_documents(messy.where("doc_id in (6, 10)"), 1).count() == 2


def test_likeness_counts_order_and_survives_a_round_trip():
    a, b = "the first half of a longer sentence goes here, " * 4, "and quite another one follows after it. " * 4
    x, y = sm.anchors(a + b), sm.anchors(b + a)
    assert sm.likeness(x, x) == 1.0 and 0 < sm.likeness(x, y) < 1
    again = sm.unpack_anchors(sm.pack_anchors(x))
    assert (again[0] == x[0]).all() and (again[1] == x[1]).all()


def test_long_texts_keep_all_anchors():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    a, b, passage = text(20_000), text(20_000), text(60)
    codes = np.array([ord(c) for c in a], "uint64")
    assert len(sm.anchors(a)[0]) > 0.99 * len(sm.closed_syncmers(codes))
    x, y = sm.anchors(a[:50_000] + passage + a[50_000:]), sm.anchors(b + passage)
    assert sm.likeness(x, y) > 0
    for k in range(20):
        at = 4_000 * k + 17
        changed = a[:at] + "zzzzz" + a[at + 5:]
        assert sm.fingerprint(changed) != sm.fingerprint(a) and 0.99 < sm.likeness(sm.anchors(changed), sm.anchors(a)) < 1
    again = sm.unpack_anchors(sm.pack_anchors(x))
    assert (again[0] == x[0]).all() and (again[1] == x[1]).all()
    wide = np.array([3, 5, 9], "uint32"), np.array([300_000_000, 0, 128], "uint32")
    assert all((p == q).all() for p, q in zip(sm.unpack_anchors(sm.pack_anchors(wide)), wide))


def test_extreme_and_large_ids_beside_nulls(spark):
    ids = [2**63 - 1, 2**60 + 3, 2**60 + 1, 5, -2**63, None]
    docs = [(d, f"{k} the text of a document with number {k * 77}") for k, d in enumerate(ids)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 4):
        got = {r.doc_id: r for r in sm.fingerprint_documents(df, parts).collect()}
        assert len(got) == len(ids)
        for (d, text), (_, after) in zip(docs, docs[1:] + docs[:1]):     # descending ids, null last
            edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
