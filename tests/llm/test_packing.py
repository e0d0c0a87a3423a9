import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from labelaudit.llm import packing

VOCABULARY, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


def check_packing(documents, rows, limit):
    exact = Tokenizer.from_file(VOCABULARY)
    want = defaultdict(int)
    for d in documents:
        ids = [*exact.encode(d.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % limit + 1 if len(ids) > limit else len(ids)
        edges = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), -(-sum(k[3] * n for k, n in got.items()) // limit)


def test_pack_edge_cases(messy, nothing):
    rows = packing.pack(messy, VOCABULARY, RANKS).collect()
    used, least = check_packing(messy.collect(), rows, 2048)
    assert used <= least + 1
    assert packing.pack(nothing, VOCABULARY, RANKS).count() == 0


def test_pack_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check_packing(docs.collect(), packing.pack(docs, VOCABULARY, RANKS).collect(), 2048)
    assert used <= 1.01 * least + 1


def test_fast_and_exact_ids_are_equal():
    rng, fast, exact = random.Random(3), packing.make_encoder(VOCABULARY, RANKS), packing.make_encoder(VOCABULARY)
    alphabet = [chr(c) for c in range(0x250)] + list(" \n\t'ers12") * 20
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(200)))
        assert fast(text).tolist() == exact(text).tolist()


def test_evolution_never_loses_pieces_and_beats_its_start():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 60) for _ in range(150)), reverse=True)
        start = packing.best_fit([], list(range(150)), lengths, 100)
        best = packing.evolve(lengths, [], 100, rng, rounds=15)[0]
        assert sorted(i for b in best for i in b) == list(range(150))
        assert all(sum(lengths[i] for i in b) <= 100 for b in best)
        assert len(best) <= len(start)


def test_no_search_once_no_packing_has_fewer(monkeypatch):
    made, keep = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda *args: made.append(1) or keep(*args))
    lengths = sorted(([60, 40] * 50), reverse=True)
    best = packing.evolve(lengths, [], 100, random.Random(2))
    assert len(best[0]) == 50 and len(made) == 1
    assert [len(p) for p in packing.evolve(lengths, best, 100, random.Random(3))] == [50] and len(made) == 1
    hard = sorted([51] * 30 + [34] * 30, reverse=True)          # the bound, 26, cannot be met
    packing.evolve(hard, [], 100, random.Random(2))
    assert len(made) > packing.POPULATION


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, 2**60 + 3, -2**63, 2**63 - 1, None]
    docs = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in packing.pack(docs, VOCABULARY, RANKS).collect()), key=str) == sorted(ids, key=str)
