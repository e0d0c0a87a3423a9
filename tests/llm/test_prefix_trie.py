import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from labelaudit.llm import prefix_trie as pt

WORDS = re.compile("[^\x20\x09-\x0D]+")


def remainder(c):
    return c - int(c / 20) * 20              # as in SQL, with the sign of c


def brute(rows):
    """All nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - remainder(c), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in members:
        below, todo = [], [node]
        while todo:
            below.append(todo.pop())
            todo += children[below[-1]]
        saved = sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]),
                    sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, rest=pt.REST):
    rows = pt.conversation_trie(df, rest).collect()
    tour = sorted(x for r in rows for x in (r.enter_at, r.leave_at))
    assert tour == list(range(2 * len(rows)))          # every arc has its place
    for r in rows:
        assert (r.leave_at == r.enter_at + 1) == (r.n_children == 0)
    return sorted((tuple(r[:8]) for r in rows), key=str)


def make(rng, n):
    """Conversations that share first turns, with hot first turns, gaps, turns in any order and ids below 0."""
    texts = ["", "a b", "a  b\tc", "héllo wörld", "z " * 40, None]
    rows = []
    for c in rng.sample(range(-60, 4 * n), n):
        for turn in range(rng.randrange(6)):
            few = texts[:2] if turn < 3 else texts
            rows.append((c, turn * 2, rng.choice(["user", "user", "assistant", None]), rng.choice(few)))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,n,rest", [(1, 250, pt.REST), (2, 400, 20)])
def test_against_brute_force(spark, seed, n, rest):
    rows = make(random.Random(seed), n)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), rest) == brute(rows)


def test_messy_rows(spark):
    """Null turns, roles, texts and ids, repeated rows, a long text, a conversation of a third of all
    rows, a large group of copies, columns named as the operator's own."""
    rows = [(1, None, "user", "x"), (1, None, None, None), (1, 3, "user", None), (None, 1, "user", "lost"), (2, 0, "user", "w " * 30_000)]
    rows += [(7, 1, "user", "same")] * 5 + [(40, k, "user", f"t {k}") for k in range(400)]
    rows += [(c, k, "user", f"copy {k}") for c in range(100, 180) for k in range(4)]
    rows += [(2**60 + 1, 0, "user", "far"), (2**60 + 3, 0, "user", "far"), (-(2**63) + 20, 0, "user", "least")]
    df = spark.createDataFrame([(*r, 5, "n", 1) for r in rows], SCHEMA + ", depth int, nid string, one int")
    assert got(df.repartition(3)) == brute(rows)


def test_without_conversations_or_turns(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)      # loses its only turn, and has no lender
    rows = [(one, 0, "user", "gone")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) == [
        (one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]


@pytest.mark.parametrize("n,rest", [(1, 1), (2, 1), (500, 30)])
def test_list_rank(spark, n, rest):
    """A list in random order, halved down to the rest."""
    ids = np.random.default_rng(5).permutation(10 * n)[:n].tolist()
    rows = [(a, b, 1, a % 3, a % 7) for a, b in zip(ids, ids[1:] + [pt.END])]
    places = pt.list_rank(spark.createDataFrame(rows, "segment long, next long, steps long, leaves long, saved long"), rest).collect()
    assert sorted((r.segment, r.steps, r.leaves, r.saved) for r in places) == sorted(
        (a, k, sum(x % 3 for x in ids[:k]), sum(x % 7 for x in ids[:k])) for k, a in enumerate(ids))
