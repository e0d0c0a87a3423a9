"""The label-free and the labelled work of many (source, seed) at once.

The group columns go through everything: one read of the corpus, one plan each for the subsample,
the split, the flips, the folds, the forests, the neighbours, the scores and the metrics of all groups. Only
what Spark ML fits is fitted group by group, several at a time, each on the files of its own group."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import knn, models as md, scores as sc
from ..operators.features import Preprocessor
from ..operators.sampling import fold_groups, noise_groups, split_groups, subsample_groups
from ..operators.views import view_pool
from ..session import scratch_path, stored
from .scoring import Settings, combine_scores

GROUP = ["source", "seed"]
AT_ONCE = 8                  # groups whose models are fitted at the same time
REAL = 0.0                   # the rate of labels as they are


@dataclass
class Grid:
    """Tables of all groups; each has the columns of `GROUP`."""
    rows: DataFrame          # id, y, split, headers, request
    labels: DataFrame        # rate, id, y (as given at that rate), mask, fold; training rows
    placed: DataFrame        # id, y, split, features, embedding, cluster_p, cluster
    instability: DataFrame   # id, score; training rows
    graded: DataFrame        # method, id, y, proba, cluster; what baselines say of the test rows
    oof: DataFrame           # rate, id, y, p
    settings: Settings


def fit_group(rows: DataFrame, seed: int, settings: Settings) -> dict[str, DataFrame]:
    """The fits of one group, but for its forests: tables of `Grid` by name, without the group columns."""
    train = rows.where("split = 'train'")
    pre = Preprocessor(settings.svd_dim, max_features=settings.max_features, seed=seed).fit(train)
    features = stored(pre.transform(rows).join(rows.select("id", "y", "split"), "id"), "features")
    inside, outside = (features.where(F.col("split") == side) for side in ("train", "test"))
    soft = md.SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(inside, "features")
    placed = stored(soft.transform(features, "features"), "placed")
    inside, outside = (placed.where(F.col("split") == side) for side in ("train", "test"))
    pool = view_pool(train.select("id", "headers", "request"), settings.views, settings.view_config, seed)
    moved = soft.transform(pre.transform(pool, ("id", "view")), "features")

    slim = lambda d, vec: d.select("id", "y", vec)
    said = []
    for method, vec, model in (
            ("LogReg", "features", md.fit_logreg(slim(inside, "features"), "features")),
            ("Embedding + probe", "embedding", md.fit_logreg(slim(inside, "embedding"), "embedding"))):
        scored = md.predict_proba(model, slim(outside, vec), vec, "p")
        said.append(scored.select(F.lit(method).alias("method"), "id", "y", F.col("p")[1].alias("proba"), F.lit(None).cast("int").alias("cluster")))
    dims = min(32, settings.svd_dim)
    for method, clusters in (
            ("KMeans (raw)", md.kmeans(slim(inside, "features"), slim(outside, "features"), "features", 2, seed, settings.restarts)),
            ("PCA + KMeans", md.pca_kmeans(slim(inside, "features"), slim(outside, "features"), "features", dims, 2, seed, settings.restarts)),
            ("Soft clusters", inside)):
        said.append(clusters.select(F.lit(method).alias("method"), "id", "y", F.lit(None).cast("double").alias("proba"), F.col("cluster").cast("int")))
    graded = said[0]
    for part in said[1:]:
        graded = graded.unionByName(part)

    return {"placed": placed, "instability": sc.view_instability(moved, "cluster_p"), "graded": graded}


def fit_grid(df: DataFrame, seeds: Sequence[int], rates: Sequence[float], settings: Settings = Settings(),
             subsample: int | None = None, audit_seed: int | None = None, at_once: int = AT_ONCE) -> Grid:
    """`df`: (source, id, y, headers, request), ids unique within a source. All rows are used unless a
    `subsample` of so many rows, balanced by class, is asked for per group. The groups of `audit_seed`
    are also scored with the labels as they are, as rate 0."""
    spark = df.sparkSession
    every = df.select("source", "id", "y", "headers", "request").withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    if subsample:
        every = subsample_groups(stored(every, "grid"), GROUP, subsample)
    rows = stored(split_groups(stored(every, "grid"), GROUP, settings.test_size), "split", GROUP)
    noisy = noise_groups(rows.where("split = 'train'").select(*GROUP, "id", "y"), GROUP, [REAL, *rates])
    noisy = noisy.where((F.col("rate") > REAL) | (F.col("seed") == F.lit(audit_seed)))
    noisy = stored(noisy.select(*GROUP, "rate", "id", F.col("y_noisy").alias("y"), "mask"), "noisy")
    labels = stored(fold_groups(noisy, [*GROUP, "rate"], settings.folds), "labels", GROUP)
    groups = [tuple(r) for r in rows.select(*GROUP).distinct().collect()]      # sources x seeds
    roots = {name: scratch_path(spark, name) for name in ("placed", "instability", "graded")}

    def work(task) -> dict:
        number, (source, seed) = task
        own = (F.col("source") == F.lit(source)) & (F.col("seed") == F.lit(seed))
        found = fit_group(rows.where(own).drop(*GROUP), seed, settings)
        kinds = {}
        for name, table in found.items():
            table = table.withColumns({"source": F.lit(source).cast(rows.schema["source"].dataType), "seed": F.lit(seed)})
            table.write.parquet(f"{roots[name]}/{number}")
            kinds[name] = table.schema
        return kinds

    with ThreadPoolExecutor(at_once) as pool:
        kinds = list(pool.map(work, enumerate(sorted(groups, key=str))))[0]
    spark.catalog.clearCache()
    read = lambda name: spark.read.schema(kinds[name]).parquet(*[f"{roots[name]}/{i}" for i in range(len(groups))])
    placed, instability, graded = (read(name) for name in ("placed", "instability", "graded"))
    forests, oof = group_forests(placed, labels, int(seeds[0]), settings)
    return Grid(rows, labels, placed, instability, graded.unionByName(forests), oof, settings)


def group_forests(placed: DataFrame, labels: DataFrame, seed: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """What the forests of all groups say, in one job each: (graded, oof) of `Grid`."""
    sides = placed.select(*GROUP, "id", "y", "features", F.when(F.col("split") == "train", -1).otherwise(0).alias("fold"))
    said = md.fold_forests(sides, "features", "y", settings.baseline_trees, seed, settings.max_depth, GROUP)
    graded = said.select(F.lit("RandomForest").alias("method"), "id", "y", F.col("p")[1].alias("proba"), F.lit(None).cast("int").alias("cluster"), *GROUP)
    given = labels.select(*GROUP, "rate", "id", "y", "fold").join(placed.where("split = 'train'").select(*GROUP, "id", "features"), [*GROUP, "id"])
    oof = md.fold_forests(given, "features", "y", settings.trees, seed, settings.max_depth, [*GROUP, "rate"])
    return graded, oof.select(*GROUP, "rate", "id", "y", "p")


def grid_graphs(grid: Grid) -> dict[str, DataFrame]:
    """The neighbours of all training rows within their group, in both spaces."""
    train = grid.placed.where("split = 'train'")
    return {"KNN raw": knn.knn_graph(train, grid.settings.knn_k, vec="features", by=GROUP),
            "KNN CC": knn.knn_graph(train, grid.settings.knn_k, vec="embedding", by=GROUP)}


def grid_scores(grid: Grid, graphs: dict[str, DataFrame]) -> DataFrame:
    """(source, seed, rate, id, y, mask, all scores, cl_flag) of every training row at every rate."""
    train = grid.placed.where("split = 'train'").drop("y", "split")
    return combine_scores(train, graphs["KNN raw"], graphs["KNN CC"], grid.instability, grid.oof,
                          grid.labels.drop("fold"), [*GROUP, "rate"])
