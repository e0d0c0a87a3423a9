import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from labelaudit.llm import decontaminate as dc
from labelaudit.llm import texts as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(words):
    return [tuple(words[k:k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def brute(doc, item):
    """Best (similarity, first word) of the item's windows in a document, if 0.8 or more."""
    a, b = WORD.findall(lower(doc or "")), WORD.findall(lower(item or ""))
    if not b or (len(b) < 5) != (len(a) < 5) or len(b) < 5 and a != b:
        return None
    want, best = Counter(shingles(b)), None
    for k in range(len(a) - len(b) + 1) if len(b) >= 5 else [0]:
        here = Counter(shingles(a[k:k + len(b)]))
        alike = sum((want & here).values()) / sum((want | here).values())
        if alike >= 0.8 and (best is None or alike > best[0]):
            best = alike, k
    return best


def make(rng):
    vocabulary = [f"w{k}" for k in range(400)] + ["ÄB", "été"]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 70))) for _ in range(40)] + ["", None, "a b a b a b a b a b a b"]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(200))
        item = (rng.choice(items) or "x").split()
        for _ in range(rng.randrange(4)):
            if item and rng.random() < 0.5:
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
        at = rng.randrange(len(words) + 1)
        docs.append("\t ".join(words[:at] + [w.upper() for w in item] + words[at:]))
    return docs + ["", None, "   ", items[0], "a b " * 30], items


def test_against_brute_force(spark):
    docs, items = make(random.Random(5))
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    want = {(i, j): best for i, x in enumerate(docs) for j, y in enumerate(items) if (best := brute(x, y))}
    assert len(want) > 40
    for block in (20_000, 7):
        rows = dc.contaminated(d, b, block=block).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in rows}
        assert len(rows) == len(got) and set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 65536, (200, dc.BLOCKS)).astype("uint16")
    windows = items[rng.integers(0, 200, 60)].copy()
    for w in windows:
        for _ in range(rng.integers(0, 80)):
            w[rng.integers(dc.BLOCKS)] ^= np.uint16(1 << rng.integers(16))
    far = np.bitwise_count(windows[:, None] ^ items[None]).sum(axis=2)
    want = set(zip(*np.nonzero(far <= dc.RADIUS)))
    assert set(zip(*dc.Index(items).within(windows))) == want and len(want) > 20


def test_repeated_shingles_stay_within_the_radius(spark):
    items, docs = [], []
    for k in range(6):
        head, tail = [f"a{k}x{i}" for i in range(90)], [f"b{k}x{i}" for i in range(92)]
        items.append(" ".join(head + ["_"] * 22 + tail))
        docs.append(" ".join(["before"] + head + ["_"] * 2 + [f"c{k}x{i}" for i in range(18)] + ["_"] * 2 + tail + ["after"]))
    want = {(k, k): best for k in range(6) if (best := brute(docs[k], items[k]))}
    assert len(want) == 6
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in dc.contaminated(d, b).collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_edge_cases(spark, messy, nothing):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "one"), (2, None)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in dc.contaminated(messy, bench).collect())
    assert got == [(-1, 1), (6, 1), (7, 1), (7, 1), (8, 1), (11, 1), (13, 1)]
    assert dc.contaminated(nothing, bench).count() == 0 and dc.contaminated(messy, bench.limit(0)).count() == 0


def test_words_and_shingles_by_definition():
    rng, table = random.Random(6), tx.Powers(tx.BASE)
    texts = ["".join(rng.choices("aBc é\t\n\x1f\xa0", k=rng.randrange(40))) for _ in range(200)] + ["", None]
    data, offsets = tx.raw(pa.array(texts, pa.string()))
    words, first = tx.word_hashes(data, offsets, table)
    want = [WORD.findall(lower(t or "")) for t in texts]
    flat = [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]
    assert len(set(zip(flat, words.tolist()))) == len(set(flat)) == len(set(words.tolist()))
    hashes, owner, _ = tx.shingle_hashes(words, first)
    expected = [(k, s) for k, ws in enumerate(want) for s in shingles(ws)]
    assert owner.tolist() == [k for k, _ in expected]
    assert len({(s, h) for (_, s), h in zip(expected, hashes.tolist())}) == len({s for _, s in expected}) == len(set(hashes.tolist()))
    assert list(tx.chunks(offsets, 100))[-1][1] == len(texts)
