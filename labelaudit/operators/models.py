"""Spark ML models behind the baselines, the probes and the out-of-fold scores.

All take and give DataFrames; vectors are array columns, turned into ML vectors
only here. Probability columns come back as arrays."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import l2_normalize
from ..session import stored
from ..sizes import SMALL_ROWS
from . import forests
from .sampling import stratified_folds

_VEC = "ml_vector"
FOREST_NODES = 400_000       # tree nodes that lie in the driver at the same time


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(_VEC, array_to_vector(F.col(vec).cast("array<double>")))


def _scored(model, df: DataFrame, vec: str, out: str) -> DataFrame:
    """`df` with the probability array `out`."""
    kept = model.transform(_vectors(df, vec))
    return kept.select(*df.columns, vector_to_array("probability").alias(out))


def fit_logreg(train: DataFrame, vec: str, label: str = "y", max_iter: int = 2000):
    """L2 logistic regression with C = 1: the penalty is 1 / n in Spark's scale."""
    n = train.count()
    return LogisticRegression(featuresCol=_VEC, labelCol=label, maxIter=max_iter,
                              regParam=1.0 / n, standardization=False, tol=1e-6).fit(_vectors(train, vec))


def fit_rows(train: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """`train`; only if a caller asks for at most `most` rows and it has more, a sample of about so many by a
    hash of the row, which leaves every class its share. No plan and no query asks for it."""
    if most is None or (n := train.count()) <= most:
        return train
    return train.where(F.pmod(F.xxhash64(F.lit(seed), *train.columns), F.lit(1 << 40)) < F.lit((most << 40) // n))


def fit_forest(train: DataFrame, vec: str, label: str = "y", trees: int = 200, seed: int = 42,
               max_depth: int = 30, most: int | None = None):
    """Random forest on all rows; each row remembers its tree nodes, which deep trees need. Trees of that
    depth grow with the rows and lie in the driver: `forest_proba` bounds how many at a time."""
    train = fit_rows(train, most, seed)
    return RandomForestClassifier(featuresCol=_VEC, labelCol=label, numTrees=trees, seed=seed,
                                  maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                  cacheNodeIds=True, maxMemoryInMB=512).fit(_vectors(train, vec))


def fit_mlp(train: DataFrame, vec: str, label: str = "y", seed: int = 42, max_iter: int = 60):
    """A small net from scratch."""
    width = train.agg(F.max(F.size(vec))).first()[0]
    return MultilayerPerceptronClassifier(
        featuresCol=_VEC, labelCol=label, layers=[width, 128, 64, 64, 2], seed=seed,
        maxIter=max_iter).fit(_vectors(train, vec))


def predict_proba(model, df: DataFrame, vec: str, out: str = "p") -> DataFrame:
    return _scored(model, df, vec, out)


def kmeans(train: DataFrame, test: DataFrame, vec: str, k: int = 2, seed: int = 42,
           restarts: int = 10, out: str = "cluster") -> DataFrame:
    """`test` with the cluster of the best of `restarts` fits on `train`."""
    data = _vectors(train, vec).select(_VEC).persist()
    best = min((KMeans(featuresCol=_VEC, k=k, seed=seed + i, predictionCol=out).fit(data)
                for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(_vectors(test, vec)).select(*test.columns, out)


def fit_pca(train: DataFrame, vec: str, k: int = 32):
    """Principal components and the mean that the projection subtracts."""
    from .features import moments
    return PCA(k=k, inputCol=_VEC, outputCol="pca").fit(_vectors(train, vec)), moments(train, vec)[0]


def pca_project(fitted, df: DataFrame, vec: str, out: str = "pca") -> DataFrame:
    """`df` with the centred projection as array<double>."""
    from .features import array_lit
    model, mean = fitted
    centred = df.withColumn("_centred", F.zip_with(
        F.col(vec).cast("array<double>"), array_lit(mean), lambda x, m: x - m))
    moved = model.transform(_vectors(centred, "_centred"))
    return moved.select(*df.columns, vector_to_array("pca").alias(out))


def pca_kmeans(train: DataFrame, test: DataFrame, vec: str, dims: int = 32, k: int = 2,
               seed: int = 42, restarts: int = 10) -> DataFrame:
    fitted = fit_pca(train, vec, dims)
    moved = pca_project(fitted, test, vec, "_pca")
    out = kmeans(pca_project(fitted, train, vec, "_pca"), moved, "_pca", k, seed, restarts)
    return out.drop("_pca")


class SoftClusters:
    """Embedding and soft clusters of a feature vector: PCA to `dims`, unit
    length, and a mixture of k Gaussians."""

    def __init__(self, k: int = 4, dims: int = 8, seed: int = 42):
        self.k, self.dims, self.seed = k, dims, seed

    def fit(self, train: DataFrame, vec: str) -> "SoftClusters":
        self.pca = fit_pca(train, vec, self.dims)
        emb = self.embed(train.select(vec), vec)
        self.model = GaussianMixture(featuresCol=_VEC, k=self.k, seed=self.seed, maxIter=50).fit(
            _vectors(emb, "embedding"))
        return self

    def embed(self, df: DataFrame, vec: str) -> DataFrame:
        """Adds `embedding`."""
        moved = pca_project(self.pca, df, vec, "_pca")
        return moved.withColumn("embedding", l2_normalize("_pca")).drop("_pca")

    def transform(self, df: DataFrame, vec: str) -> DataFrame:
        """Adds `embedding`, `cluster_p` (sums to 1) and `cluster`."""
        emb = self.embed(df, vec)
        out = self.model.transform(_vectors(emb, "embedding"))
        return out.select(*emb.columns, vector_to_array("probability").alias("cluster_p"),
                          F.col("prediction").cast("int").alias("cluster"))


def _row_chances(trees_of, trees: int, depth: int, rows: int, df: DataFrame, vec: str, nodes: int) -> DataFrame:
    """(row, p) for `df` (row, vec): the mean over all trees, fitted some at a time so that about `nodes`
    nodes are held. `trees_of(n, i)` fits the i-th forest, of n trees."""
    each, left, parts = min(2 ** min(depth + 1, 40), 2 * rows) + 1, trees, []
    while left:
        some = min(left, max(1, int(nodes // each)))
        model = trees_of(some, len(parts))
        each, left = 1.25 * model.totalNumNodes / some, left - some
        said = _scored(model, df.select("row", vec), vec, "p").select("row", "p")
        if some == trees:
            return stored(said, "chances")
        parts.append(stored(said.withColumn("p", F.transform("p", lambda x: x * some)), "chances"))
        classes = model.numClasses
        del model
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*[F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(classes)])
    return sums.select("row", F.array(*[F.col(f"p{i}") / trees for i in range(classes)]).alias("p"))


def _in_parts(train: DataFrame, df: DataFrame, vec: str, label: str, trees: int, seed: int, max_depth: int, most: int | None, nodes: int, out: str) -> DataFrame:
    """`forest_proba` by Spark ML: the forest is fitted and asked in parts of about `nodes` nodes, as its trees
    lie in the driver; the first part has the seed itself."""
    train = train if most is None else stored(fit_rows(train, most, seed), "forest_rows")
    numbered = stored(df.withColumn("row", F.monotonically_increasing_id()), "numbered")
    fit = lambda n, i: fit_forest(train, vec, label, n, seed + 1_000_003 * i, max_depth, None)
    chances = _row_chances(fit, trees, max_depth, train.count(), numbered, vec, nodes)
    return numbered.join(chances.withColumnRenamed("p", out), "row").drop("row")


def fold_forests(rows: DataFrame, vec: str, label: str = "y", trees: int = 200, seed: int = 42, max_depth: int = 30,
                 by: Sequence[str] = (), nodes: int | None = None, out: str = "p") -> DataFrame:
    """The rows whose `fold` is not negative, without `vec`, with the probability array `out` of a forest fitted
    on all rows of their group (`by`) in other folds; rows of a negative fold are only fitted on. Labels are
    0, 1, .... One job for all groups and folds (`forests`) as long as a task can hold the rows of a group as
    bytes; larger groups, or all if `nodes` is given, go through Spark ML in parts of so many nodes."""
    spark, by = rows.sparkSession, list(by)
    kept = [c for c in rows.columns if c != vec]
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(label).alias("most"), F.max(F.size(vec)).alias("width")).limit(SMALL_ROWS + 1).collect()
    if len(found) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} groups")
    classes = 1 + max((int(r["most"]) for r in found if r["most"] is not None), default=1)
    if nodes or classes > 100 or any(r["n"] * r["width"] > forests.TASK_BYTES for r in found):
        parts, rows = [], stored(rows, "forest_rows")
        for r in found:
            own = rows.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in by], F.lit(True)))
            for (fold,) in sorted(own.where("fold >= 0").select("fold").distinct().collect()):
                parts.append((own.where(F.col("fold") != fold), own.where(F.col("fold") == fold)))
        some = lambda p: _in_parts(*p, vec, label, trees, seed, max_depth, None, (nodes or FOREST_NODES) // min(4, len(parts)), out).select(*kept, out)
        with ThreadPoolExecutor(4) as pool:
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(some), parts))
    if by:
        fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
        numbers = spark.createDataFrame([(*[r[c] for c in by], i) for i, r in enumerate(found)], f"{fields}, grp int")
        rows = rows.join(F.broadcast(numbers), by)
    else:
        rows = rows.withColumn("grp", F.lit(0))
    # equal rows of a fold get equal answers, so a hash of all that a row has tells enough of them apart
    rows = rows.select("grp", F.xxhash64(*kept, vec).alias("row"), *kept, vec)
    cuts = forests.column_cuts(rows, vec)
    table = stored(forests.as_bytes(rows, vec, cuts), "bytes")
    chances = forests.votes(table.select("grp", "row", F.col("fold").cast("int").alias("fold"), F.col(label).cast("byte").alias("y"), "x"),
                            {i: r["n"] for i, r in enumerate(found)}, classes, trees, seed, max_depth)
    told = table.where("fold >= 0").select("row", *kept)
    return told.join(stored(chances.withColumnRenamed("p", out), "chances"), "row").drop("row")


def forest_proba(train: DataFrame, df: DataFrame, vec: str, label: str = "y", trees: int = 200, seed: int = 42, max_depth: int = 30,
                 most: int | None = None, nodes: int | None = None, out: str = "p") -> DataFrame:
    """`df` with the probability array `out` of a forest on all rows of `train`: `fold_forests` of one fold."""
    if nodes or most is not None:
        return _in_parts(train, df, vec, label, trees, seed, max_depth, most, nodes or FOREST_NODES, out)
    df = stored(df.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    none = F.lit(None).cast("long")
    rows = train.select(F.lit(-1).alias("fold"), none.alias("_number"), F.col(label).alias("_label"), F.col(vec).alias("_vec")).unionByName(
        df.select(F.lit(0).alias("fold"), "_number", F.lit(0).alias("_label"), F.col(vec).alias("_vec")))
    said = fold_forests(rows, "_vec", "_label", trees, seed, max_depth, out=out)
    return df.join(said.select("_number", out), "_number").drop("_number")


def oof_probabilities(df: DataFrame, vec: str, label: str = "y", seed: int = 42, folds: int = 4,
                      trees: int = 150, max_depth: int = 30, id_col: str = "id",
                      most: int | None = None, nodes: int | None = None) -> DataFrame:
    """(id, label, p): each row scored by a forest that never saw its fold, fitted on all rows of the other
    folds. With `most` or `nodes` the forests are fitted by Spark ML on so many rows or in parts of so many nodes."""
    dealt = stratified_folds(df.select(id_col, label, vec), folds, seed, label, id_col)
    dealt = stored(dealt, "folds")
    if not nodes and most is None:
        return fold_forests(dealt, vec, label, trees, seed, max_depth).select(id_col, label, "p")

    def work(fold: int) -> DataFrame:
        return _in_parts(dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold),
                         vec, label, trees, seed, max_depth, most, (nodes or FOREST_NODES) // folds, "p").select(id_col, label, "p")

    with ThreadPoolExecutor(folds) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(dealt.sparkSession)(work), range(folds)))
