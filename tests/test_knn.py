"""Neighbours against brute force, with cells, blocks, copies and zero vectors."""
import numpy as np
import pandas as pd
import pytest

from labelaudit.operators import knn


def brute(ids, x, k, metric):
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1, keepdims=True)
        unit = x / np.where(size > 0, size, 1)
        dist = np.clip(1 - unit @ unit.T, 0, 2)
    else:
        dist = np.linalg.norm(x[:, None, :] - x[None, :, :], axis=2)
    dist = np.round(dist, 9)
    out = {}
    for i, own in enumerate(ids):
        near = sorted((dist[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[int(own)] = [int(j) for _, j in near]
    return out


def found(df):
    rows = df.orderBy("id", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["id"], []).append(r["nbr_id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("case", ["blobs", "copies", "zeros"])
def test_matches_brute_force(spark, metric, case):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((60, 5)) * 0.1 + rng.standard_normal(5) * 3 for _ in range(5)])
    if case == "copies":                      # one vector holds a third of the rows
        x[rng.permutation(len(x))[:100]] = x[7]
    if case == "zeros":
        x[::9] = 0.0
    ids = rng.permutation(5000)[:len(x)].astype("int64")
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "v": list(x)})).repartition(3)
    got = found(knn.knn_graph(df, 4, metric=metric, cell_rows=40, block_rows=16))
    assert got == brute(ids, x, 4, metric)


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert found(knn.knn_graph(df, 20)) == {1: [2], 2: [1]}


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert knn.knn_graph(df, 20).count() == 0


def test_share_of_other_labels(spark):
    """A bot among 18 humans and 2 bots scores 0.9."""
    rows = [(0, [1.0, 0.0], 1)] + [(i, [1.0, i / 1000], 0 if i <= 18 else 1) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    score = knn.knn_disagreement(knn.knn_graph(df, 20), df).where("id = 0").first()["score"]
    assert score == pytest.approx(0.9)


def test_unknown_metric(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    with pytest.raises(ValueError):
        knn.knn_graph(df, 1, metric="nope")


def test_labels_of_hot_neighbours(spark):
    """One row that is everybody's neighbour joins like any other."""
    graph = spark.createDataFrame([(i, 0 if i else 1, 0.1, 1) for i in range(500)] +
                                  [(i, (i + 1) % 500, 0.2, 2) for i in range(1, 400)],
                                  "id long, nbr_id long, dist double, rank int")
    labels = spark.createDataFrame([(i, r, (i + r) % 2) for i in range(500) for r in (0, 1)],
                                   "id long, rate int, y int")
    plain = labels.where("rate = 0")
    got = knn.with_labels(graph, plain)
    assert got.count() == graph.count()
    assert got.where("y <> id % 2 OR nbr_y <> nbr_id % 2").count() == 0
    grid = knn.with_labels(graph, labels, by=["rate"])
    assert grid.count() == 2 * graph.count()
    assert grid.where("y <> (id + rate) % 2 OR nbr_y <> (nbr_id + rate) % 2").count() == 0


def test_string_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 4))
    x[50:] = x[3]
    ids = [f"r{i:03d}" for i in rng.permutation(90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, v array<double>")
    got = found(knn.knn_graph(df, 3, cell_rows=20, block_rows=8, tile=3))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    dist = np.round(np.clip(1 - (x / size) @ (x / size).T, 0, 2), 9)
    assert got == {a: [b for _, b in sorted((dist[i, j], ids[j]) for j in range(90) if j != i)[:3]] for i, a in enumerate(ids)}


@pytest.mark.parametrize("block", [4096, 12])
def test_groups_in_one_job(spark, block):
    """Rows meet rows of their own group only; ids may recur in other groups."""
    rng = np.random.default_rng(6)
    parts, rows = {}, []
    for g, n in (("a", 70), ("b", 3), ("c", 41)):
        x = rng.standard_normal((n, 3))
        ids = np.arange(n, dtype="int64") * 2
        parts[g] = brute(ids, x, 4, "euclidean")
        rows += [(g, 7, int(i), v.tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "g string, seed int, id long, v array<double>").repartition(3)
    graph = knn.knn_graph(df, 4, metric="euclidean", by=["g", "seed"], cell_rows=15, block_rows=block, tile=2)
    assert {g: found(graph.where(graph.g == g)) for g in parts} == parts
    labels = df.selectExpr("g", "seed", "id", "CAST(id % 4 = 0 AS INT) AS y")
    score = {(r.g, r.id): r.score for r in knn.knn_disagreement(graph, labels, by=["g", "seed"]).collect()}
    assert score == pytest.approx({(g, i): np.mean([(i % 4 == 0) != (j % 4 == 0) for j in near])
                                   for g, lists in parts.items() for i, near in lists.items()})
    weighted = {(r.g, r.id): r.score for r in knn.knn_weighted(graph, labels, by=["g", "seed"]).collect()}
    alone = knn.knn_weighted(graph.where("g = 'a'").drop("g", "seed"), labels.where("g = 'a'"))
    assert {i: s for (g, i), s in weighted.items() if g == "a"} == pytest.approx({r.id: r.score for r in alone.collect()})


def test_tiles_send_fewer_vectors(spark, monkeypatch):
    """Without structure every block is met; a vector goes out once per tile, so tiles of
    eight blocks send an eighth of the vectors. The neighbours are the same."""
    x = np.random.default_rng(7).standard_normal((512, 24))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(512), "v": list(x)})).repartition(3)
    sent, got, plain = {}, {}, knn.stored
    for tile in (1, 8):
        monkeypatch.setattr(knn, "stored", lambda d, name="part", tile=tile: (
            out := plain(d, name), sent.setdefault(tile, out.count()) if name == "visits" else None)[0])
        got[tile] = found(knn.knn_graph(df, 5, cell_rows=64, block_rows=8, tile=tile))
    assert got[1] == got[8] == brute(np.arange(512), x, 5, "cosine")
    assert sent[8] < sent[1] / 6


def test_a_tile_keeps_no_more_than_the_best_of_each_query():
    """Sixteen blocks, text ids and ties; what is held does not grow with the blocks met."""
    import tracemalloc
    from labelaudit.operators.knn import _meet
    rng, n, blocks, k = np.random.default_rng(2), 3000, 16, 20
    points = pd.DataFrame({"v": list(rng.integers(-3, 4, (1600, 6)).astype(float)), "block": np.arange(1600) % blocks,
                           "members": [np.array([f"m{i}", f"n{i}"], object) for i in range(1600)]})
    queries = pd.DataFrame({"pid": np.arange(n), "v": list(rng.integers(-3, 4, (n, 6)).astype(float)), "bound": np.inf,
                            "blocks": [np.arange(blocks)] * n, "rooms": [np.full(blocks, -np.inf)] * n})
    tracemalloc.start()
    got = _meet(queries, points, k, "euclidean")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    dist = np.linalg.norm(np.stack(queries["v"])[:, None] - np.stack(points["v"])[None], axis=2)
    for pid in range(0, n, 97):
        want = sorted((d, m) for d, ms in zip(dist[pid], points["members"]) for m in ms)[:k + 1]
        own = got[got["pid"] == pid]
        assert [(round(d, 9), m) for d, m in sorted(zip(own["dist"], own["nbr_id"]))] == [(round(d, 9), m) for d, m in want]
