"""G1-G7, Q3 on the embedding table: fitted on train, graded on test."""
from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import models as md
from labelaudit.operators.clusters import clustering_metrics
from labelaudit.operators.metrics import classification_metrics
from labelaudit.operators.sampling import stratified_split

from labelaudit.session import stored

from .q_knn import rounded
from .registry import register
from .views import vectors


def _parts(spark, sf):
    rows = stratified_split(vectors(spark, sf).select("id", "v", "y"))
    rows = stored(rows, "split")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _metrics(scored):
    return rounded(classification_metrics(scored.select("id", "y", F.col("p")[1].alias("p"))))


def _graded(model, test):
    return _metrics(md.predict_proba(model, test, "v"))


@register("kmeans")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return md.kmeans(train, test, "v").select("id", "y", "cluster")


@register("pca_kmeans")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return md.pca_kmeans(train, test, "v").select("id", "y", "cluster")


@register("soft_clusters")
def _(spark, sf):
    train, test = _parts(spark, sf)
    soft = md.SoftClusters(4, 8).fit(train, "v").transform(test, "v")
    return soft.select("id", "cluster", F.round(F.aggregate(
        "cluster_p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("cluster_p"), 6).alias("largest"))


@register("logreg")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return _graded(md.fit_logreg(train, "v"), test)


@register("random_forest")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return _metrics(md.forest_proba(train, test, "v"))


@register("linear_probe")
def _(spark, sf):
    train, test = _parts(spark, sf)
    soft = md.SoftClusters(4, 32).fit(train, "v")
    model = md.fit_logreg(soft.embed(train, "v"), "embedding")
    scored = md.predict_proba(model, soft.embed(test, "v"), "embedding")
    return rounded(classification_metrics(scored.select("id", "y", F.col("p")[1].alias("p"))))


@register("mlp_scratch")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return _graded(md.fit_mlp(train, "v"), test)


@register("oof_probabilities")
def _(spark, sf):
    oof = md.oof_probabilities(vectors(spark, sf), "v")
    return oof.select("id", "y", F.round(F.col("p")[0] + F.col("p")[1], 6).alias("total"),
                      F.round(F.col("p")[1], 6).alias("p_bot"))


@register("cluster_grading")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return rounded(clustering_metrics(md.kmeans(train, test, "v", restarts=3)))
