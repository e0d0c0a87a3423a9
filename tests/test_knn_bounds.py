"""The neighbour search holds little at a time and looks only below what it has."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from labelaudit.functions.vectors import l2_normalize
from labelaudit.operators import knn


def test_visits_are_listed_in_small_steps(monkeypatch):
    """Each step of the routing looks at a bounded number of (row, cell) pairs."""
    batch = pd.DataFrame({"x": np.arange(10_000)})
    steps = list(knn._steps(iter([batch]), 300, knn.ROUTE_CELLS))
    assert max(map(len, steps)) * 300 <= 1 << 18 and sum(map(len, steps)) == 10_000


def test_a_known_bound_leaves_the_same_neighbours():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, queries = unit(rng.standard_normal((500, 8))), unit(rng.standard_normal((40, 8)))
    points = pd.DataFrame({"v": list(vectors), "members": [np.array([i, 1000 + i]) for i in range(500)]})
    plain = knn._nearest(queries, points, 5, "cosine")
    last = np.array([plain[2][plain[0] == q].max() for q in range(40)])
    for bound in (last, last + 0.3):
        bounded = knn._nearest(queries, points, 5, "cosine", bound)
        assert all(np.array_equal(a, b) for a, b in zip(plain, bounded))
    short = knn._nearest(queries, points, 5, "cosine", last - 1e-9)
    assert len(short[0]) < len(plain[0]) and (short[2] < last[short[0]]).all()


def test_only_what_passes_the_bound_becomes_a_distance(monkeypatch):
    monkeypatch.setattr(knn, "_distances", lambda *a: 1 / 0)
    points = pd.DataFrame({"v": list(np.eye(4)), "members": [np.array([i]) for i in range(4)]})
    q, nbr, dist = knn._nearest(np.eye(4), points, 1, "cosine", np.full(4, 0.5))
    assert nbr.tolist() == [0, 1, 2, 3] and (dist == 0).all()


def test_the_size_of_a_vector_is_worked_out_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    got = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0], None, []]
    plan = df.select(l2_normalize("v").alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
