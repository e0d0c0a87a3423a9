"""Forests see every row, are one job, and split where an exhaustive search would."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from labelaudit.operators import forests as fo, metrics as mt, models as md


def test_forests_are_fitted_on_all_rows(spark, monkeypatch):
    """Of more than 200,000 rows some were left out before."""
    df = spark.range(220_000, numPartitions=4).selectExpr("id", "int(id % 2) AS y", "array(double(id % 2), double(id % 5)) AS v")
    seen, real = [], md._vectors
    monkeypatch.setattr(md, "_vectors", lambda rows, vec: seen.append(rows.count()) or real(rows, vec))
    md.fit_forest(df, "v", trees=1, max_depth=1)
    assert seen == [220_000]
    assert md.fit_rows(df).count() == 220_000


def made(spark, n=600, partitions=3):
    return spark.range(n, numPartitions=partitions).selectExpr(
        "id", "int(id % 2) AS side", "array(sin(id * 7), cos(id * id), sin(id * id * 3), double(id % 4)) AS v", "cast(sin(id * 7) + cos(id * id) > 0 AS int) AS y")


def test_no_tree_comes_to_the_driver(spark, monkeypatch):
    """A forest whose rows a task can hold is grown by tasks, whatever its depth."""
    monkeypatch.setattr(md, "fit_forest", lambda *a, **b: 1 / 0)
    df = made(spark)
    oof = md.oof_probabilities(df, "v", trees=12)
    assert oof.count() == 600 and oof.where("abs(p[0] + p[1] - 1) > 1e-9").count() == 0
    assert mt.classification_metrics(oof.select("id", "y", F.col("p")[1].alias("p"))).first()["auc"] > 0.9
    train, test = df.where("id < 400"), df.where("id >= 400").withColumn("y", F.lit(0))     # labels of test rows are not read
    got = md.forest_proba(train, test.unionByName(test), "v", trees=12).join(df.select("id", F.col("y").alias("true")), "id")
    assert got.count() == 400 and mt.classification_metrics(got.select("id", "true", F.col("p")[1].alias("p")), "true").first()["auc"] > 0.9


def test_groups_folds_and_partitions_change_nothing(spark):
    answers = lambda d: {(r["side"], r["id"]): r["p"] for r in d.collect()}
    rows = made(spark).withColumn("fold", (F.col("id") % 3 - 1).cast("int"))      # -1 is only fitted on
    both = answers(md.fold_forests(rows, "v", trees=5, by=["side"]))
    assert len(both) == 400
    again = answers(md.fold_forests(rows.repartition(7), "v", trees=5, by=["side"]))
    assert both.keys() == again.keys() and all(np.allclose(both[k], again[k], atol=1e-12) for k in both)
    alone = answers(md.fold_forests(rows.where("side = 1"), "v", trees=5))
    assert all(np.allclose(both[k], alone[k], atol=1e-12) for k in alone) and len(alone) == 200
    two, alone = (answers(md.fold_forests(rows.where(w), "v", trees=5)) for w in ("fold < 1", "fold = 0 OR fold = -1"))
    assert two == alone


def test_large_groups_still_get_whole_forests(spark, monkeypatch):
    monkeypatch.setattr(fo, "TASK_BYTES", 100)
    rows = made(spark, 300).withColumn("fold", (F.col("id") % 3 - 1).cast("int"))
    got = md.fold_forests(rows, "v", trees=3, max_depth=4, by=["side"])
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    assert got.columns == ["id", "side", "y", "fold", "p"]


@pytest.mark.parametrize("n,classes", [(40, 2), (3000, 3), (30_000, 2)])
def test_splits_are_those_of_an_exhaustive_search(n, classes):
    rng = np.random.default_rng(n)
    code, node = rng.integers(0, 9, n) * 5, np.sort(rng.integers(0, 4, n))
    node[:4] = range(4)
    node = np.sort(node)
    y, weight = rng.integers(0, classes, n), rng.integers(1, 4, n)
    total = np.array([[weight[(node == i) & (y == c)].sum() for c in range(classes)] for i in range(4)], float)
    purity, cut = fo._best(code, node, y, weight, 4, classes, total)
    for i in range(4):
        best = (-np.inf, 0)
        for c in range(256):
            left = np.array([weight[(node == i) & (code <= c) & (y == k)].sum() for k in range(classes)], float)
            right = total[i] - left
            if left.sum() and right.sum():
                value = (left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum()
                best = max(best, (value, -c))
        assert np.isclose(purity[i], best[0]) and (cut[i] == -best[1] or np.isclose(purity[i], best[0], rtol=1e-13))


def test_a_tree_grown_to_the_end_knows_its_rows():
    rng = np.random.default_rng(5)
    x, y = np.unique(rng.integers(0, 256, (3000, 4)), axis=0).astype("uint8"), None
    y = rng.integers(0, 2, len(x)).astype("int8")
    weight = np.ones(len(x), "uint8")
    tree = fo.grow(x, y, weight, 2, 60, rng)
    out = np.zeros((len(x), 2))
    fo.ask(tree, x, np.arange(len(x)), out)
    assert (out.argmax(1) == y).mean() > 0.97      # a node without a gain in the columns tried is a leaf
    assert fo.grow(x, np.zeros(len(x), "int8"), weight, 2, 60, rng)[0].tolist() == [-1]
    shallow = fo.grow(x, y, weight, 2, 3, rng)
    assert len(shallow[0]) <= 15


def test_cuts_are_taken_from_all_rows(spark):
    """Few values are all told apart, however rare; many are cut in even shares; NaN is no value."""
    df = spark.range(50_000, numPartitions=5).selectExpr("0 AS grp", "array(if(id = 777, 9.0D, double(id % 3)), double(id), if(id % 2 = 0, double('NaN'), 1.0D)) AS v")
    few, many, one = fo.column_cuts(df, "v")[0]
    assert few.tolist() == [0.5, 1.5, 5.5] and len(one) == 0
    assert 240 <= len(many) <= 255
    shares = np.diff(np.searchsorted(np.arange(50_000), np.r_[-1, many, 50_000]))
    assert shares.max() < 3 * 50_000 / 256
    codes = fo.as_bytes(df, "v", {0: [few, many, one]}).collect()
    assert max(bytes(r["x"])[0] for r in codes) == 3 and {bytes(r["x"])[2] for r in codes} == {0}


def test_bootstrap_counts_are_poisson():
    mark = np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 200_000)
    w = fo._weights(mark, 42, 0)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs(np.corrcoef(w, fo._weights(mark, 42, 1))[0, 1]) < 0.02
