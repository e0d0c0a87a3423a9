"""Groups as columns give what each group gives alone."""
import pytest
from pyspark.sql import functions as F

from checks.views import corpus
from labelaudit.operators import sampling as sp
from labelaudit.session import stored

BY = ["source", "seed"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    some = corpus(spark, sf).select("id", "y", (F.col("source") % 3).alias("source"))
    return stored(some.withColumn("seed", F.explode(F.array(F.lit(42), F.lit(7)))))


def alone(rows, source, seed):
    return rows.where((F.col("source") == source) & (F.col("seed") == seed)).drop(*BY)


def same(a, b, columns):
    return sorted(map(tuple, a.select(*columns).collect())) == sorted(map(tuple, b.select(*columns).collect()))


@pytest.mark.parametrize("source,seed", [(0, 42), (2, 7)])
def test_splits_flips_folds_and_samples(rows, source, seed):
    own = alone(rows, source, seed)
    assert same(alone(sp.split_groups(rows, BY, 0.3), source, seed), sp.stratified_split(own, 0.3, seed), ["id", "y", "split"])
    assert same(alone(sp.subsample_groups(rows, BY, 40), source, seed), sp.balanced_subsample(own, 40, seed), ["id", "y"])
    assert same(alone(sp.fold_groups(rows, BY, 4), source, seed), sp.stratified_folds(own, 4, seed), ["id", "y", "fold"])
    grid = sp.noise_grid(own, [0.0, 0.1, 0.2], [seed])
    assert same(alone(sp.noise_groups(rows, BY, [0.0, 0.1, 0.2]), source, seed), grid, ["id", "rate", "mask", "y_noisy"])


def test_a_group_that_cannot_be_split(spark):
    rows = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 1, 1), (3, 1, 1, 1)], "id long, y int, source int, seed int")
    with pytest.raises(ValueError):
        sp.split_groups(rows, BY)
    with pytest.raises(ValueError):
        sp.subsample_groups(rows, BY, 1)
