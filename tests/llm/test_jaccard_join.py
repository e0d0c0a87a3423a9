import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelaudit.llm import jaccard_join as jj
from labelaudit.llm import texts as tx
from labelaudit.llm.components import components
from tests.llm.test_decontaminate import WORD, lower, shingles


def brute(docs):
    """{row: (n, least id of the component)} by all pairs."""
    sets = [frozenset(shingles(WORD.findall(lower(t or "")))) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(j)] = root(k)
    low = {}
    for k, (d, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), d), d)
    return sorted((d, len(s), low[root(k)] if s else d) for k, ((d, _), s) in enumerate(zip(docs, sets)))


def families(rng, n=60):
    vocabulary = [f"w{k}" for k in range(300)]
    passage = rng.choices(vocabulary, k=40)
    docs = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 9, 12, 20, 40, 90, 200, 400]))
        if rng.random() < 0.5:
            base = passage + base
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                if rng.random() < 0.5:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                else:
                    at = rng.randrange(len(copy) + 1)
                    copy[at:at + rng.randrange(3)] = rng.choices(vocabulary, k=rng.randrange(4))
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_every_similar_pair_shares_a_signature():
    """The pigeonhole: some segment that the smaller set looks up by, after any it may leave out."""
    rng = random.Random(8)
    docs = [t for _, t in families(rng, 150)]
    data, offsets = tx.raw(pa.array(docs))
    hashes, sizes, ids = jj.shingle_sets(data, offsets, tx.Powers(tx.BASE))
    sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    rows = defaultdict(dict)
    for s, i, f in zip(*(x.tolist() for x in jj.signatures(hashes, sizes, ids))):
        rows[i][s] = max(f, rows[i].get(s, 0))
    tested = 0
    for a in range(len(docs)):
        for b in range(len(docs)):
            if len(sets[a]) > len(sets[b]) or ids[a] == ids[b] or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both):
                continue
            tested += 1
            x, y = rows[ids[a]], rows[ids[b]]
            hits = [s for s, f in x.items() if f & jj.PROBE and s in y and (f & jj.EXACT or y[s] & jj.EXACT)]
            spare, dear = max(f // jj.LEFT for f in x.values()), set()
            for h in hits:             # the dearest case: what it leaves out is what would have found the other
                spare -= 2 if x[h] & jj.EXACT and x[h] & jj.DEEP else 1
                if spare >= 0:
                    dear.add(h)
            assert set(hits) - dear, (len(sets[a]), len(hits))
    assert tested > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    docs = families(random.Random(seed))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, a int, set_id int").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df).collect())
    assert got == brute(docs)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype("uint64")
    sizes = rng.integers(0, 2500, 60)
    sets = [rng.choice(pool, k, replace=False) for k in sizes]
    bits = jj.parity_sketches(np.concatenate(sets), sizes)
    for i in range(60):
        for j in range(60):
            apart = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            differ = len(np.setxor1d(sets[i], sets[j]))
            assert apart <= differ and (apart - differ) % 2 == 0


def test_short_sketches_are_no_farther_apart(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 2000).astype("uint64")
    sets = [rng.choice(pool, k, replace=False) for k in rng.integers(0, 900, 30)]
    bits = jj.parity_sketches(np.concatenate(sets), np.array([len(x) for x in sets])).view("int64")
    df = spark.createDataFrame([(k, len(x), b.tolist()) for k, (x, b) in enumerate(zip(sets, bits))], "set_id long, size int, sketch array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(30) for j in range(i)], "a long, b long")
    short = {(r.a, r.b): r.apart for r in jj.sketched(pairs, df, "a", "b", True).collect()}
    for r in jj.sketched(pairs, df, "a", "b").collect():
        assert short[r.a, r.b] <= r.apart <= len(np.setxor1d(sets[r.a], sets[r.b]))
    assert max(short.values()) > 100


# every large group by differences, by rare shingles (with hot ones and without), by both, by all pairs
@pytest.mark.parametrize("large, near, far, hot", [(1, 1.0, 0.6, 1024), (1, 99, 99, 1024), (1, -1, 0, 1024), (1, -1, 0, 4), (10**9, 1.0, 0.6, 1024)])
def test_one_large_family_either_way(spark, monkeypatch, large, near, far, hot):
    """Copies of one text with one to six edits each: some pairs are similar, most are not."""
    for name, value in (("LARGE", large), ("NEAR", near), ("FAR", far), ("HOT_SHARE", hot)):
        monkeypatch.setattr(jj, name, value)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(145)]
    docs = families(rng, 30)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.choice([rng.randrange(145), rng.randrange(20)])] = f"e{rng.randrange(500)}"
        docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.near_duplicates(df).collect()) == brute(docs)


def test_a_set_of_many_groups_is_compared_with_one_leader(spark, monkeypatch):
    """Sets of one family share signatures with many leaders; their differences are made once."""
    made = []
    keep = jj.stored
    monkeypatch.setattr(jj, "stored", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    monkeypatch.setattr(jj, "LARGE", 1)
    rng = random.Random(9)
    docs = []
    for k in range(150):
        copy = [f"b{k}" for k in range(145)]
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(145)] = f"e{rng.randrange(500)}"
        docs.append((k, " ".join(copy)))
    got = jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)
    by_name = dict(made)
    leaders = by_name["family"].groupBy("set_id").count().agg({"count": "max"}).first()[0]
    rows = by_name["differences"].select("set_id", "leader").distinct().groupBy("set_id").count()
    assert leaders > 1 and rows.agg({"count": "max"}).first()[0] == 1


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = jj.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def test_edge_cases(messy, nothing):
    got = jj.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[3].component_id == 3 and by_id[5].component_id == 4 and by_id[7].component_id == 6
    assert by_id[8].component_id == 6 and by_id[11].n_shingles == 1 and by_id[11].component_id == 11
    assert by_id[14].component_id == 14 and by_id[15].component_id == 15
    assert jj.near_duplicates(nothing).count() == 0


def test_components_of_chains_stars_and_hubs(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (202, 201), (7, 7)]
    random.Random(1).shuffle(links)
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_are_met_once_and_those_asked_for_stay(spark):
    ids = [0, 1, -1, 7, 7 + jj.BLOOM, 32767, 32768, 32769, jj.BLOOM - 1, 2 ** 63 - 1, -2 ** 63]
    table = spark.createDataFrame([(x, [x]) for x in ids + ids], "set_id long, elements array<long>")
    assert sorted(r.set_id for r in jj.once(table).collect()) == sorted(ids)
    for x in ids:
        found = jj.once(table, spark.createDataFrame([(x,), (x,)], "set_id long")).collect()
        assert sorted((r.set_id, r.elements) for r in found) == sorted(
            (y, [y]) for y in ids if (y - x) % jj.BLOOM == 0)
