"""Scores graded against known flips."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import knn
from ..operators.metrics import noise_detection_metrics
from ..operators.features import Preprocessor
from ..operators.models import SoftClusters
from ..operators.sampling import noise_grid, stratified_split
from ..session import stored
from .scoring import SCORES, Settings, Space, fit_space, long_scores, score_table


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def noise_scores(train: DataFrame, space: Space, rates: Sequence[float],
                 mode: str = "symmetric") -> DataFrame:
    """Every score of every training row at every rate, with the flip mask."""
    grid = noise_grid(train.select("id", "y"), rates, [space.seed], mode).select(
        "id", "rate", F.col("y_noisy").alias("y"), "mask")
    return score_table(space, stored(grid, "labels"), rates)


def synthetic_noise_study(df: DataFrame, rates=(0.01, 0.03, 0.05, 0.10, 0.20),
                          seeds=(42, 7, 123, 2024, 999), mode: str = "symmetric",
                          settings: Settings = Settings(), ks=(50, 100, 200),
                          names: Sequence[str] = SCORES) -> DataFrame:
    """(score, rate, seed, roc_auc, auprc, base_rate, precision_at_k, recall_at_k).
    Rates are a column; only the fits run once per seed."""
    parts = []
    for seed in seeds:
        split = stratified_split(df, settings.test_size, seed)
        train = stored(split.where("split = 'train'"), "train")
        space = fit_space(train, settings, seed)
        table = noise_scores(train, space, rates, mode)
        graded = noise_detection_metrics(
            long_scores(table, ["rate"], names), "score", "mask", ks, ["score_name", "rate"])
        parts.append(graded.withColumn("seed", F.lit(int(seed))))
    return _union(parts).withColumnRenamed("score_name", "score")


def knn_variants(graphs: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(variant, id, score, mask): plain and weighted disagreement per graph."""
    parts = []
    for name, graph in graphs.items():
        parts.append(knn.knn_disagreement(graph, labels).withColumn("variant", F.lit(name)))
        parts.append(knn.knn_weighted(graph, labels).withColumn("variant", F.lit(f"{name} (weighted)")))
    return _union(parts).join(labels.select("id", "mask"), "id")


def knn_study(df: DataFrame, seeds=(42, 7, 123), rate: float = 0.10, mode: str = "symmetric",
              settings: Settings = Settings(), ks=(50, 100, 200)) -> DataFrame:
    """(variant, seed, roc_auc, auprc, ...): neighbour scores in the feature space
    and in the embedding; one graph per space and seed."""
    parts = []
    for seed in seeds:
        train = stratified_split(df, settings.test_size, seed).where("split = 'train'")
        train = stored(train, "train")
        pre = Preprocessor(settings.svd_dim, max_features=settings.max_features, seed=seed).fit(train)
        features = stored(pre.transform(train), "features")
        soft = SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(features, "features")
        rows = stored(soft.embed(features, "features"), "rows")
        graphs = {"KNN raw": knn.knn_graph(rows, settings.knn_k, vec="features"),
                  "KNN CC": knn.knn_graph(rows, settings.knn_k, vec="embedding")}
        labels = noise_grid(train.select("id", "y"), [rate], [seed], mode).select(
            "id", F.col("y_noisy").alias("y"), "mask")
        labels = stored(labels, "labels")
        graded = noise_detection_metrics(knn_variants(graphs, labels), "score", "mask", ks, ["variant"])
        parts.append(graded.withColumn("seed", F.lit(int(seed))))
    return _union(parts)
