"""Baselines, probes, label efficiency and ablation over seeds.

All give a long table (method, metric, seed, value) for `reports.mean_std`."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import models as md
from ..operators.clusters import clustering_metrics
from ..operators.features import VARIANTS, build_features
from ..operators.metrics import classification_metrics
from ..operators.sampling import label_subset
from ..session import stored
from .noise import _union
from .scoring import Settings

# Metric names.
CLASS_METRICS = ("f1", "auc", "acc", "precision", "recall")
CLUSTER_METRICS = ("ari", "nmi", "cluster_acc", "entropy", "n_nonempty")


def _long(metrics: DataFrame, names: Sequence[str], **labels) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                      for n in names])
    return metrics.select(*[F.lit(v).alias(k) for k, v in labels.items()],
                          F.explode(pairs).alias("m")).select(*labels, "m.metric", "m.value")


def probe(train: DataFrame, test: DataFrame, vec: str) -> DataFrame:
    """Logistic probe on a frozen vector: classification metrics on test."""
    return _graded(md.fit_logreg(train, vec), test, vec)


def _graded(model, test: DataFrame, vec: str) -> DataFrame:
    return _grades(md.predict_proba(model, test, vec, "proba"))


def _forest_graded(train: DataFrame, test: DataFrame, vec: str, settings: Settings, seed: int) -> DataFrame:
    return _grades(md.forest_proba(train, test, vec, "y", settings.baseline_trees, seed, settings.max_depth, out="proba"))


def _grades(scored: DataFrame) -> DataFrame:
    scored = scored.withColumn("proba", F.col("proba")[1])
    return classification_metrics(scored.select("id", "y", "proba"), "y", "proba")


def split_features(df: DataFrame, settings: Settings, seed: int, **variant):
    """Train and test rows with features fitted on train."""
    rows, fitted = build_features(df, settings.test_size, seed, svd_dim=settings.svd_dim,
                                  max_features=settings.max_features, **variant)
    rows = stored(rows, "split")
    return rows.where("split = 'train'"), rows.where("split = 'test'"), fitted


def run_baselines(df: DataFrame, seeds=(42, 7, 123), settings: Settings = Settings(),
                  **variant) -> DataFrame:
    """k-means, PCA + k-means, logistic regression, forest, and the embedding
    probe, on held-out rows."""
    parts = []
    for seed in seeds:
        train, test, _ = split_features(df, settings, seed, **variant)
        tag = lambda m: {"method": m, "seed": int(seed)}
        raw = md.kmeans(train, test, "features", 2, seed, settings.restarts)
        parts.append(_long(clustering_metrics(raw), CLUSTER_METRICS, **tag("KMeans (raw)")))
        pca = md.pca_kmeans(train, test, "features", min(32, settings.svd_dim), 2, seed, settings.restarts)
        parts.append(_long(clustering_metrics(pca), CLUSTER_METRICS, **tag("PCA + KMeans")))
        parts.append(_long(_graded(md.fit_logreg(train, "features"), test, "features"),
                           CLASS_METRICS, **tag("LogReg")))
        parts.append(_long(_forest_graded(train, test, "features", settings, seed), CLASS_METRICS, **tag("RandomForest")))
        soft = md.SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(train, "features")
        inside = stored(soft.transform(train, "features"), "inside")
        parts.append(_long(probe(inside, soft.embed(test, "features"), "embedding"),
                           CLASS_METRICS, **tag("Embedding + probe")))
        parts.append(_long(clustering_metrics(inside), CLUSTER_METRICS, **tag("Soft clusters")))
    return _union(parts)


def label_efficiency(df: DataFrame, seeds=(42, 7, 123), fractions=(0.01, 0.05, 0.10, 0.25, 0.50, 1.00),
                     settings: Settings = Settings(),
                     methods=("logreg", "rf", "mlp_scratch", "embedding_probe")) -> DataFrame:
    """(method, fraction, metric, seed, value): test metrics when only a share of
    the training labels is used."""
    parts = []
    for seed in seeds:
        train, test, _ = split_features(df, settings, seed)
        soft = md.SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(train, "features")
        train, test = (stored(soft.embed(d, "features"), "embedded") for d in (train, test))
        for fraction in fractions:
            some = stored(label_subset(train, fraction, seed), "subset")
            fits = {
                "logreg": lambda: probe(some, test, "features"),
                "rf": lambda: _forest_graded(some, test, "features", settings, seed),
                "mlp_scratch": lambda: _graded(md.fit_mlp(some, "features", "y", seed), test, "features"),
                "embedding_probe": lambda: probe(some, test, "embedding"),
            }
            for method in methods:
                parts.append(_long(fits[method](), CLASS_METRICS, method=method,
                                   fraction=float(fraction), seed=int(seed)))
    return _union(parts)


def ablation(df: DataFrame, seed: int = 42, settings: Settings = Settings(),
             variants: Sequence[str] = tuple(VARIANTS)) -> DataFrame:
    """(variant, method, metric, seed, value) of each feature variant."""
    return _union([run_baselines(df, [seed], settings, **VARIANTS[name]).withColumn(
        "variant", F.lit(name)) for name in variants])


def cluster_study(df: DataFrame, seed: int = 42, settings: Settings = Settings()):
    """Soft clusters on three axes. Returns (assignments, metrics): id, split, y,
    cluster, embedding, cluster_p; and the long table of clustering metrics on
    both sides plus the probe."""
    train, test, _ = split_features(df, settings, seed)
    soft = md.SoftClusters(settings.clusters, settings.embedding_dims, seed).fit(train, "features")
    inside = stored(soft.transform(train, "features"), "inside")
    outside = stored(soft.transform(test, "features"), "outside")
    table = _union([
        _long(clustering_metrics(inside), CLUSTER_METRICS, part="clustering_train"),
        _long(clustering_metrics(outside), CLUSTER_METRICS, part="clustering_test"),
        _long(probe(inside, outside, "embedding"), CLASS_METRICS, part="representation_probe")])
    return inside.unionByName(outside).drop("features"), table
