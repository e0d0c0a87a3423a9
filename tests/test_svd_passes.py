"""Narrow rows are read once for a whole SVD."""
import numpy as np
import pytest

from labelaudit.operators import svd


def rows_of(spark, n, width, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        place = np.unique(np.r_[0, rng.integers(0, width, 12)])
        rows.append((i, place.tolist(), rng.integers(1, 6, len(place)).astype(float).tolist()))
    return spark.createDataFrame([*rows, (n, [], [])], "id int, idx array<int>, val array<double>").repartition(3)


@pytest.mark.parametrize("idf", [None, np.linspace(1, 3, 90)])
def test_one_pass_gives_what_seven_gave(spark, monkeypatch, idf):
    rows = rows_of(spark, 300, 90)
    monkeypatch.setattr(svd, "NARROW", 0)
    wide, large = svd.svd_fit(rows, 90, 8, idf=idf)
    monkeypatch.undo()
    monkeypatch.setattr(svd, "_gram_product", lambda *a: 1 / 0)
    narrow, small = svd.svd_fit(rows, 90, 8, idf=idf)
    assert np.allclose(large, small, rtol=1e-9) and np.allclose(wide, narrow, atol=1e-7)


def test_the_small_matrix_is_that_of_all_rows(spark):
    rows = rows_of(spark, 200, 70)
    a = np.zeros((201, 70))
    for r in rows.collect():
        a[r["id"], r["idx"]] = r["val"]
    assert np.allclose(svd._gram_matrix(rows, 70, None), a.T @ a)
