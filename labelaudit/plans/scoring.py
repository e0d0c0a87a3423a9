"""All suspicion scores of one corpus.

Features, embedding, clusters, neighbour graphs and view instability do not
depend on the labels: they are made once and serve every noise rate."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import knn, scores as sc
from ..operators.features import Preprocessor
from ..operators.models import SoftClusters, fold_forests, oof_probabilities
from ..operators.sampling import fold_groups
from ..operators.views import view_pool
from ..session import stored

# Scores in table order.
SCORES = ("confident_learning", "knn_raw", "knn_cc", "cluster_entropy", "view_instability",
          "cluster_label_mismatch", "centroid_own_distance", "centroid_relative_distance", "ensemble")


@dataclass(frozen=True)
class Settings:
    """Sizes of a run."""
    svd_dim: int = 64
    max_features: int = 5000
    clusters: int = 4
    embedding_dims: int = 8
    views: int = 5
    view_config: str = "medium_http_aug"
    knn_k: int = 20
    folds: int = 4
    trees: int = 150
    max_depth: int = 30
    baseline_trees: int = 200
    restarts: int = 10
    test_size: float = 0.3


@dataclass
class Space:
    """Label-free work on one set of rows."""
    rows: DataFrame          # id, features, embedding, cluster_p, cluster
    raw_graph: DataFrame
    cc_graph: DataFrame
    instability: DataFrame   # id, score
    preprocessor: Preprocessor
    clusters: SoftClusters
    seed: int
    settings: Settings


def fit_space(df: DataFrame, settings: Settings, seed: int,
              preprocessor: Preprocessor | None = None) -> Space:
    """`df` has id, headers and request. Without a fitted preprocessor one is
    fitted on these rows (no labels are read)."""
    pre = preprocessor or Preprocessor(settings.svd_dim, max_features=settings.max_features,
                                       seed=seed).fit(df)
    features = stored(pre.transform(df), "features")
    clusters = SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(features, "features")
    rows = stored(clusters.transform(features, "features"), "rows")
    pool = view_pool(df.select("id", "headers", "request"), settings.views, settings.view_config, seed)
    moved = clusters.transform(pre.transform(pool, ("id", "view")), "features")
    instability = stored(sc.view_instability(moved, "cluster_p"), "instability")
    raw = knn.knn_graph(rows, settings.knn_k, vec="features")
    cc = knn.knn_graph(rows, settings.knn_k, vec="embedding")
    return Space(rows, raw, cc, instability, pre, clusters, seed, settings)


def score_table(space: Space, labels: DataFrame, rates: Sequence[float] = ()) -> DataFrame:
    """One row per label row with every score and `cl_flag`.

    `labels` has id and y, and `rate` where `rates` are given: then all rates are
    scored together, the forests of all rates in one job."""
    by = ["rate"] if rates else []
    s, features = space.settings, space.rows.select("id", "features")
    if rates:
        given = labels.where(F.col("rate").isin([float(r) for r in rates])).select("rate", "id", "y").withColumn("seed", F.lit(int(space.seed)))
        dealt = stored(fold_groups(given, ["seed", "rate"], s.folds), "folds").drop("seed")
        oof = fold_forests(dealt.join(features, "id"), "features", "y", s.trees, space.seed, s.max_depth, by).select("rate", "id", "y", "p")
    else:
        oof = oof_probabilities(labels.select("id", "y").join(features, "id"), "features", "y", space.seed, s.folds, s.trees, s.max_depth)
    return combine_scores(space.rows, space.raw_graph, space.cc_graph, space.instability, stored(oof, "oof"), labels, by)


def combine_scores(rows: DataFrame, raw_graph: DataFrame, cc_graph: DataFrame, instability: DataFrame, oof: DataFrame,
                   labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All scores of `labels` (by, id, y, ...), from (by, id, y, p) in `oof`. Columns of `by` that the
    label-free tables have are joined on; for the others these are the same."""
    key = [*by, "id"]
    same = [c for c in by if c in rows.columns]
    confident = sc.confident_learning(oof, "y", "p", by).select(
        *key, F.col("score").alias("confident_learning"), F.col("flag").alias("cl_flag"), "p")
    raw = knn.knn_disagreement(raw_graph, labels, "y", by).withColumnRenamed("score", "knn_raw")
    cc = knn.knn_disagreement(cc_graph, labels, "y", by).withColumnRenamed("score", "knn_cc")
    placed = labels.join(rows.drop("features"), [*same, "id"]).withColumn(
        "cluster_entropy", sc.cluster_entropy("cluster_p"))
    placed = sc.centroid_distances(placed, "embedding", "y", by).withColumnsRenamed(
        {"own_distance": "centroid_own_distance", "relative_distance": "centroid_relative_distance"})
    placed = sc.cluster_label_mismatch(placed, "cluster", "y", by).withColumnRenamed(
        "score", "cluster_label_mismatch").drop("embedding", "cluster_p", "opposite_distance")
    table = (placed.join(confident, key).join(raw, key).join(cc, key)
             .join(instability.withColumnRenamed("score", "view_instability"), [*same, "id"]))
    return sc.ensemble(stored(table, "scores"), by=by)


def long_scores(table: DataFrame, by: Sequence[str] = (), names: Sequence[str] = SCORES) -> DataFrame:
    """(by, id, mask, score_name, score)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("score"))
                      for n in names])
    return table.select(*by, "id", "mask", F.explode(pairs).alias("s")).select(
        *by, "id", "mask", "s.score_name", "s.score")
