from collections import defaultdict

import numpy as np
import pytest

from labelaudit.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=nv.COSINE):
    """All pairs in double precision, components by flooding."""
    def fine(v, label):
        return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    near = defaultdict(set)
    units = {k: np.array(v) / np.max(np.abs(v)) for k, (_, v, label) in enumerate(rows) if fine(v, label)}
    for a in units:
        for b in units:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]):
                x, y = units[a], units[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        first = min(ids, default=None)
        out.append((i, len(near[k]), first, first == i))
    return sorted(out, key=str)


def got(df, **more):
    return sorted((tuple(r) for r in nv.near_vectors(df, **more).collect()), key=str)


def make(rng, n, dims, spread):
    """Clouds around centres at all distances about the threshold."""
    centres = rng.normal(size=(12, dims))
    rows = []
    for k in range(n):
        c = int(rng.integers(12))
        v = centres[c] + rng.normal(size=dims) * rng.choice(spread)
        rows.append((int(k * 3), (v * 10.0 ** rng.integers(-3, 4)).tolist(), c % 3))
    return rows


@pytest.mark.parametrize("dims,block", [(64, 8192), (3, 40), (1500, 50)])
def test_against_brute_force(spark, dims, block):
    rng = np.random.default_rng(dims)
    rows = make(rng, 240, dims, [0.0, 0.05, 0.15, 0.2, 0.25, 0.4, 2.0])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block) == brute(rows)


def test_messy_rows(spark):
    """Nulls everywhere, zeros, components that are not finite, huge and tiny numbers, other lengths,
    repeated ids and rows, a large group of copies, columns named as the operator's own."""
    inf, nan, v = float("inf"), float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, None), (None, v, 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1),
            (7, [1.0, inf, 3.0], 1), (8, [1.0, nan, 3.0], 1), (9, [1e200, 2e200, 3e200], 1), (10, [1e-200, 2e-200, 3e-200], 1),
            (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (2**60 + 1, [5.0, 0.0, 0.1], 2), (2**60 + 3, [5.0, 0.0, 0.0], 2), (None, [0.0, 7.0, 0.0], 2),
            (None, None, None), (13, [-0.0, 7.0, 0.0], 3), (14, [0.0, 7.0, 0.0], 3)]
    rows += [(100 + k, [3.0, 1.0, 0.0], 4) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", cls int, weight int, k1 string")
    assert got(df.repartition(3)) == brute(rows)
    assert nv.near_vectors(df.limit(0)).collect() == []


def test_dense_group_gives_a_forest(spark):
    """A tile of m near vectors has some m * m / 2 links, and gives a count and an edge each."""
    import pyarrow as pa
    rng = np.random.default_rng(1)
    m, dims = 700, 64
    v = rng.normal(size=dims) + rng.normal(size=(m, dims)) * 0.02
    table = pa.table({"cls": np.arange(m), "weight": np.ones(m, "int64"), "block": np.zeros(m, "int32"), "embedding": pa.array(v.tolist())})
    key = tuple(pa.scalar(x) for x in (1, dims, 0, 0))
    out = nv._tile(0.98)(key, table)
    edges = out.filter(out.column("b").is_valid())
    assert edges.num_rows == m - 1 and out.num_rows == 2 * m - 1
    assert set(out.filter(out.column("b").is_null()).column("links").to_pylist()) == {m - 1}


def test_bounds_hold_and_decide_most_pairs():
    """The integer products are never off by more than the bound, and leave few pairs to full precision."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 64))
    a, b = (nv.Side(np.repeat(centre, 10, 0) + rng.normal(size=(400, 64)) * rng.choice([0.02, 0.1, 1.0], size=(400, 1))) for _ in range(2))
    held = (a.codes.astype(float) * a.step[:, None]) @ (b.codes.astype(float) * b.step[:, None]).T
    bound = a.rest[:, None] + b.rest + a.rest[:, None] * b.rest
    assert (np.abs(held - a.unit @ b.unit.T) <= bound).all()
    pieces = list(nv.tile_links(a, b, 0.98, False))
    links = {(int(i), int(j)) for x, y, _ in pieces for i, j in zip(x, y)}
    assert links == set(zip(*map(list, np.nonzero(a.unit @ b.unit.T >= 0.98)))) and 0 < sum(n for *_, n in pieces) < 400 * 400 / 50
